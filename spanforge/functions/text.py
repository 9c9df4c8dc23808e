"""Text functions: Column -> Column. Null and blank texts count as empty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Subjects left out of a subtask's text, and the keywords and prefixes of its classes.
SUBJECT = (
    r"^(?:the\s+)?(?:robotic?\s+arm|robot\s+arm|robotic?\s+manipulator|manipulator|robot\s+base|mobile\s+base|"
    r"base|chassis|robot|arm|gripper|end\s+effector)\s+"
)
BASE_MOVE = (
    "base", "chassis", "mobile base", "mobile platform", "platform", "wheeled", "drive", "drives", "driving", "navigate", "navigates",
    "navigating", "reposition the robot base", "repositions the robot base", "moves the robot base", "moves the mobile base",
)
MERGE_NEXT = (
    "approach ", "approaches ", "reach ", "reaches ", "move to ", "moves to ", "move toward ", "moves toward ", "move towards ",
    "moves towards ", "move near ", "moves near ", "move above ", "moves above ", "move around ", "moves around ", "move into position",
    "moves into position", "move into alignment", "moves into alignment", "hover ", "hovers ",
)
MERGE_PREV = (
    "remain idle", "remains idle", "remain above", "remains above", "stay idle", "stays idle", "stay above", "stays above",
    "wait ", "waits ", "waiting ", "pause ", "pauses ", "hold position", "holds position",
)
DRAWER = {
    "drawer": ("drawer",),
    "tray": ("pull-out tray", "pull out tray", "sliding tray", "slide-out tray", "slide out tray"),
    "shelf": ("pull-out shelf", "pull out shelf", "sliding shelf", "slide-out shelf", "slide out shelf"),
}
# How texts name observation images, words of opening and closing, and labels of views.
OBSERVATION = r"(?:current\s+observation\s+images?(?:\s*\([^)]*\))?\s*[:：]?|image\s*\d+\s*\([^)]*\)\s*[:：]?)"
NAMED_IMAGE = r"(?iU)\bcurrent\s+observation\s+images?(?:\s*\([^)]*\))?\s*[:：]?\s*|\bimage\s*\d+\s*\([^)]*\)\s*[:：]?\s*"
OPENING, CLOSING = r"(?i)^(?:open|opens|opening)\s+", r"(?i)^(?:close|closes|closing)\s+"
SHUT = "pushes the drawer closed"
HEAD, FRONT, LEFT_WRIST, RIGHT_WRIST, WRIST, ONLY = "head view", "front view", "left wrist view", "right wrist view", "wrist view", "current view"
CONTENT_POLICY = ("content_policy_violation", "content safety system")


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def strip(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"(?U)\s+", " ")


def normalize(c: Column) -> Column:
    return squeeze(F.lower(c))


def exact_match(a: Column, b: Column) -> Column:
    return strip(a) == strip(b)


def clean_memory(c: Column) -> Column:
    """Leaves out what names observation images, wherever it stands."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), NAMED_IMAGE, " "), r"(?U)\s+", " "), F.lit(" \t\n,;:-"))


def truncate_memory(c: Column) -> Column:
    """Cuts a predicted memory where it begins to name observation images."""
    text = strip(c)
    cut = F.regexp_replace(text, r"(?isU)[,;:\-\s]*" + OBSERVATION + r"[\s\S]*$", "")
    return strip(F.when(cut == text, text).otherwise(F.rtrim(cut, F.lit(" \t\n,;:-"))))


def subtask_text(c: Column) -> Column:
    """Without subject and final dots, beginning in lower case."""
    plain = F.regexp_replace(F.rtrim(squeeze(c), F.lit(".")), "(?i)" + SUBJECT, "")
    return F.concat(F.lower(F.left(plain, F.lit(1))), F.substr(plain, F.lit(2)))


def base_move(c: Column) -> Column:
    low = F.lower(c)
    return any_of([F.contains(low, F.lit(k)) for k in BASE_MOVE])


def auxiliary_class(c: Column) -> Column:
    """merge_prev, merge_next or null."""
    low = strip(F.lower(c))
    prev = any_of([F.startswith(low, F.lit(p)) for p in MERGE_PREV]) | F.contains(F.concat(F.lit(" "), low, F.lit(" ")), F.lit(" idle "))
    return F.when(low == "", None).when(prev, "merge_prev").when(any_of([F.startswith(low, F.lit(p)) for p in MERGE_NEXT]), "merge_next")


def drawer_type(c: Column) -> Column:
    low, out = F.lower(c), F.lit(None).cast("string")
    for kind, keys in reversed(DRAWER.items()):
        out = F.when(any_of([F.contains(low, F.lit(k)) for k in keys]), kind).otherwise(out)
    return out


def drawer_rewrite(skill: Column, text: Column) -> tuple[Column, Column]:
    """(skill, text) with opening and closing of drawer-like targets as pulling and pushing."""
    like = drawer_type(text).isNotNull()
    rest = strip(F.regexp_replace(text, CLOSING, ""))
    closing = F.when(rest == "", SHUT).otherwise(F.concat(F.lit("pushes "), rest, F.lit(" closed")))
    new_skill = F.when(like & (skill == "Open"), "Pull").when(like & (skill == "Close"), "Push").otherwise(skill)
    new_text = (
        F.when(like & (skill == "Open"), F.regexp_replace(text, OPENING, "pulls open "))
        .when(like & (skill == "Close") & F.regexp_like(text, F.lit(CLOSING)), closing)
        .otherwise(text)
    )
    return new_skill, new_text


def sentence_case(c: Column) -> Column:
    text = strip(c)
    cased = F.concat(F.upper(F.left(text, F.lit(1))), F.substr(text, F.lit(2)))
    return F.when(text == "", "").when(F.right(text, F.lit(1)).isin(".", "!", "?"), cased).otherwise(F.concat(cased, F.lit(".")))


def parse_index(c: Column) -> Column:
    """The number after episode_ or episode-, else the text as a number, else null."""
    found = F.regexp_extract(c, r"episode[_-](\d+)", 1)
    return F.coalesce(F.nullif(found, F.lit("")).try_cast("bigint"), c.try_cast("bigint"))


def index_or_text(c: Column) -> Column:
    """What parse_index finds as a text, else the text itself, trimmed."""
    return F.coalesce(parse_index(strip(c)).cast("string"), strip(c))


def slug(c: Column, most: int = 120, fallback: str = "subtask") -> Column:
    plain = F.btrim(F.regexp_replace(F.lower(subtask_text(c)), r"[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(F.left(plain, F.lit(most)), F.lit("")), F.lit(fallback))


def task_text(c: Column) -> Column:
    """What stands before the first bar."""
    return strip(F.split_part(c, F.lit("|"), F.lit(1)))


def task_from_name(c: Column) -> Column:
    """A folder's name as a task: its runs of letters in lower case."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit("([A-Za-z]+)"), 1), lambda x: F.lower(x)), " ")


def is_html(c: Column) -> Column:
    return F.regexp_like(c, F.lit(r"(?is)^\s*<(!doctype html|html)"))


def view_label(key: Column, place: Column, views: Column, high: bool = False) -> Column:
    """A camera key's view. high: a key with `high` in it is a head view too, as one of the two kinds of prompts has it."""
    low = strip(F.lower(key))
    has = lambda *xs: any_of([F.contains(low, F.lit(x)) for x in xs])
    hand = has("hand", "wrist", "arm")
    return (
        F.when(has("head", "high") if high else has("head"), HEAD)
        .when(has("front"), FRONT)
        .when(has("left") & hand, LEFT_WRIST)
        .when(has("right") & hand, RIGHT_WRIST)
        .when(hand, WRIST)
        .when(low != "", F.concat(F.replace(F.element_at(F.split(low, r"\."), -1), F.lit("_"), F.lit(" ")), F.lit(" view")))
        .when(views == 1, ONLY)
        .otherwise(F.concat(F.lit("camera view "), (place + 1).cast("string")))
    )


def active_memory(memory: Column, subtask: Column, subtasks: Column, task: Column) -> Column:
    done = F.when(F.coalesce(task, F.lit("")) != "", F.concat(F.lit("The task '"), task, F.lit("' has been completed."))).otherwise("The current task has been completed.")
    return F.when((subtask < 0) | (subtask > subtasks), None).when(subtask == subtasks, done).otherwise(F.nullif(strip(memory), F.lit("")))


def first_source(**named: Column) -> tuple[Column, Column]:
    """The first non-empty value and the name it came under."""
    kept = {k: F.nullif(strip(c), F.lit("")) for k, c in named.items()}
    source = F.coalesce(*[F.when(c.isNotNull(), k) for k, c in kept.items()])
    return F.coalesce(*kept.values()), source


def is_policy_violation(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return any_of([F.contains(low, F.lit(p)) for p in CONTENT_POLICY])


def sampling_rate(name: Column) -> Column:
    """The rate that a name's final %NN gives, else 1."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"%(\d+)$", 1), F.lit("")).try_cast("double") / 100, F.lit(1.0))


def checkpoint_step(path: Column) -> Column:
    """The number that a path ends with as checkpoint-N, else -1."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"checkpoint-(\d+)$", 1), F.lit("")).try_cast("bigint"), F.lit(-1))


def sampling_seed(seed: int, path: Column, by_step: bool = True) -> Column:
    """The seed, plus the checkpoint's step if by_step holds and there is one."""
    step = checkpoint_step(path)
    return (F.when(step >= 0, F.lit(seed) + step).otherwise(F.lit(seed)) if by_step else F.lit(seed)).cast("long")


def video_path(data_path: Column, template: Column, key: Column) -> Column:
    """data_path/template with {video_key} filled in; an error without a template."""
    given = F.coalesce(F.nullif(template, F.lit("")), F.raise_error(F.lit("an episode lacks its video_path")))
    return F.replace(F.concat(F.rtrim(data_path, F.lit("/")), F.lit("/"), given), F.lit("{video_key}"), key)
