"""Command-line and path text: normalising, tokenising, template matching. All native expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordered rewrites that make similar commands equal (Java regex, replacement).
COMMAND_REWRITES = [
    (r"\\\\\?\\", ""),
    (r"(c:\\users\\)[^\\]+", "$1<USER>"),
    (r"(\\temp\\)[a-z0-9]+\.tmp", "$1<TMPDIR>"),
    (r"rust_mozprofile\.\S+", "rust_mozprofile.<TMPPROFILE>"),
    (r"[\w\s\-_.]+\.(pdf|doc|docx|xls|xlsx|txt)", "<DOC>.$1"),
    (r'--channel="[^"]+"', "--channel=<CHANNEL>"),
    (r'(windowtitle eq )[^"*]+(\*?")', "$1<WINTITLE>$2"),
    (r'(/d\s+)"?[^"/\s][^"]*"?', "$1<REGVAL>"),
    (r"global\\[a-z_]+\d+_?", r"global\\<PIPE>"),
    (r"\{[0-9a-f<>\-_A-Z]+\}", "<GUID>"),
    (r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "<IP>"),
    (r"0x[0-9a-f]+", "<HEX>"),
    (r"\b[0-9a-f]{4,}\b", "<HEXID>"),
    (r"\b\d{3,}\b", "<NUM>"),
    (r"(?<=[a-z_])\d+", "<NUM>"),
    (r"  +", " "),
]

# How paths and command lines are cut.
DEVICE = r"[/]+Device[/]+HarddiskVolume1"
PATH_CUT = "://|:/|//|/"
COMMAND_ARGUMENT = r'"[^"]*"|\S+'
NOISE = ("", "?", "??")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


# white space of any script at either end
END_SPACE = r"^[\s\x0B\x1C-\x1F\x{85}\p{Z}]+|[\s\x0B\x1C-\x1F\x{85}\p{Z}]+$"


def normalize_cmdline(command) -> Column:
    """Lower-cased command with users, temp files, ids, addresses and numbers replaced by markers."""
    text = F.lower(_col(command))
    for pattern, replacement in COMMAND_REWRITES:
        text = F.regexp_replace(text, pattern, replacement)
    return F.regexp_replace(text, END_SPACE, "")


def _without_first(tokens: Column, value: str) -> Column:
    def cut(t: Column) -> Column:
        return F.filter(t, lambda x, n: (x != value) | (n + 1 != F.array_position(t, F.lit(value))))

    return _let(tokens, cut)


def _clean(tokens: Column, drop: str) -> Column:
    if drop == "all":
        return F.filter(tokens, lambda t: ~t.isin(*NOISE))
    for value in NOISE:
        tokens = _without_first(tokens, value)
    return tokens


def normal_path(path: Column) -> Column:
    """POSIX path normalisation: repeated slashes, ``.`` and ``..`` resolved; empty becomes ``.``."""

    def resolve(p: Column) -> Column:
        rooted = p.startswith("/")
        lead = F.when(p.rlike("^//([^/]|$)"), F.lit("//")).when(rooted, F.lit("/")).otherwise(F.lit(""))

        def step(done: Column, part: Column) -> Column:
            size = F.size(done)
            stuck = F.when(size == 0, ~rooted).otherwise(F.get(done, size - 1) == "..")
            return (
                F.when(part.isin("", "."), done)
                .when((part != "..") | stuck, F.concat(done, F.array(part)))
                .when(size > 0, F.slice(done, F.lit(1), F.greatest(size - 1, F.lit(0))))
                .otherwise(done)
            )

        parts = F.aggregate(F.split(p, "/", -1), F.array().cast("array<string>"), step)
        return F.coalesce(F.nullif(F.concat(lead, F.array_join(parts, "/")), F.lit("")), F.lit("."))

    return _let(path, resolve)


def _path_tokens(path: Column, drop: str, split_extension: bool) -> Column:
    slashed = F.regexp_replace(F.translate(path, "\\", "/"), DEVICE, "C:")
    tokens = F.split(normal_path(slashed), PATH_CUT, -1)
    if split_extension:
        tokens = _let(tokens, _cut_extension)
    return _clean(tokens, drop)


def _cut_extension(tokens: Column) -> Column:
    shape, final = r"^(.*)\.(.*?)$", F.element_at(tokens, -1)
    pieces = F.array(F.regexp_extract(final, shape, 1), F.regexp_extract(final, shape, 2))
    head = F.slice(tokens, F.lit(1), F.size(tokens) - 1)
    return F.when(final.rlike(shape), F.concat(head, pieces)).otherwise(tokens)


def tokenize_path(path, drop: str = "first", split_extension: bool = False) -> Column:
    """Path parts. ``drop`` says whether the first or all empty/``?``/``??`` parts go."""
    return _path_tokens(_col(path), drop, split_extension)


def _arguments(text: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return _let(found, lambda f: F.when(F.size(f) == 0, F.array(F.lit(""))).otherwise(f))


def tokenize_cmdline(command, drop: str = "first", split_extension: bool = False) -> Column:
    """Command tokens: the program as a path, arguments whole, as paths, or (quoted with blanks) as commands.

    Quoted arguments have lost their quotes before they are cut again, so one nested level is complete.
    """

    def as_path(text: Column) -> Column:
        return _path_tokens(text, drop, split_extension)

    def plain(argument: Column, place: Column) -> Column:
        return F.when((place == 0) | argument.rlike(r"[\\/]"), as_path(argument)).otherwise(F.array(argument))

    def tidy(parts: Column) -> Column:
        tokens = F.flatten(parts)
        return _clean(tokens, "all") if drop == "all" else _without_first(tokens, "")

    def nested(argument: Column, place: Column) -> Column:
        inner = tidy(F.transform(_arguments(argument, r"\S+"), plain))
        return F.when((place > 0) & argument.contains(" "), inner).otherwise(plain(argument, place))

    bare = F.transform(_arguments(_col(command), COMMAND_ARGUMENT), lambda a: F.replace(a, F.lit('"'), F.lit("")))
    return tidy(F.transform(bare, nested))


def text_sequence(text) -> Column:
    """Tokens joined by blanks; missing or blank text gives the empty string."""
    trimmed = F.trim(_col(text))
    joined = F.array_join(tokenize_cmdline(trimmed), " ")
    return F.when(trimmed.isNull() | (trimmed == ""), F.lit("")).otherwise(joined)


def uniform_path(path) -> Column:
    return F.replace(_col(path), F.lit("\\Device\\HarddiskVolume1"), F.lit("C:"))


def extension(path) -> Column:
    """Extension with its dot; leading dots of the last part do not start one."""
    return F.regexp_extract(_col(path), r"[^/.][^/]*?(\.[^./]*)$", 1)


def last_part(path, separator: str = "\\") -> Column:
    return F.substring_index(_col(path), separator, -1)


def match_templates(rules: Sequence[Mapping], fields: Mapping[str, str]) -> dict[str, Column]:
    """First matching rule's ``pattern_id``, ``threat_level`` and filled ``description``.

    ``rules`` are ordered dicts ``pattern_id, match_rules {field: regex}, template, threat_level``; a rule
    matches when all its regexes are found, ignoring case. ``fields`` maps rule fields to columns. The rule
    list is configuration, so it becomes one CASE expression and unmatched rows stay, with nulls.
    """
    value = {name: F.coalesce(F.col(column), F.lit("")) for name, column in fields.items()}
    blank = F.lit("")
    command, image = value.get("command_line", blank), value.get("image_path", blank)
    words = F.trim(F.regexp_replace(command, r"\s+", " "))
    known = {
        "command_line": command,
        "image_path": image,
        "parent_image": value.get("parent_image_path", blank),
        "filename": last_part(image),
        "args": F.regexp_replace(words, r"^\S* ?", ""),
    }

    def fill(template: str) -> Column:
        pieces = re.split(r"\{(\w+)\}", template)
        cols = [known[p] if n % 2 else F.lit(p) for n, p in enumerate(pieces)]
        return F.concat(*cols)

    out: dict[str, Column] = {}
    for name in ("pattern_id", "threat_level", "description"):
        chain = F.when(F.lit(False), F.lit(None).cast("string"))
        for rule in rules:
            hit = F.lit(True)
            for field, pattern in rule["match_rules"].items():
                hit = hit & value.get(field, blank).rlike(f"(?i){pattern}")
            chain = chain.when(hit, fill(rule["template"]) if name == "description" else F.lit(rule[name]))
        out[name] = chain
    return out
