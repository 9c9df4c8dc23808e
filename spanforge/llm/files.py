"""Files that Python data sources write and read in a folder shared by all executors."""

from __future__ import annotations

import json
import posixpath

MANIFEST = "_manifest.json"


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI or a local path."""
    from pyarrow import fs

    if "://" not in uri:
        return fs.LocalFileSystem(), uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def write_manifest(uri: str, body: dict) -> None:
    """Names what was committed; files of lost or repeated tasks aren't in it, so no reader sees them."""
    store, path = filesystem(uri)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(posixpath.join(path, MANIFEST)) as out:
        out.write(json.dumps(body).encode())


def read_manifest(uri: str) -> dict:
    store, path = filesystem(uri)
    with store.open_input_stream(posixpath.join(path, MANIFEST)) as f:
        return json.loads(f.readall())
