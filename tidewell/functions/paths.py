"""Path and name functions over columns (native expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories that hold generated files, endings of leftovers, scratch directories.
GENERATED = ["node_modules", "dist", "build", "target", "coverage", "logs", "log", ".venv", "venv", "__pycache__", ".gradle", ".angular", ".next", ".cache"]
LEFTOVER = [".log", ".bak", ".tmp", ".orig", ".rej"]
SCRATCH = ["/tmp/", "/var/tmp/", "/proc/", "/sys/", "/dev/"]
# File names without an ending that are still paths.
BARE_FILES = ["Makefile", "Dockerfile", "README", "LICENSE", "Cargo.lock", "Justfile", "Procfile"]


def _root(root: str) -> str:
    return root.rstrip("/")


def below(path: Column, root: str) -> Column:
    """What follows ``root/``; null outside it and for the root itself."""
    r = _root(root) + "/"
    rest = F.substr(path, F.lit(len(r) + 1))
    return F.when(path.startswith(r) & (rest != ""), rest)


def project_of(path: Column, code_root: str) -> Column:
    """First segment under the root; a file directly under the root is its own project."""
    first = F.split(below(path, code_root), "/")[0]
    return F.when(first != "", first)


def relative_to(path: Column, code_root: str) -> Column:
    """Path under the root, at least one directory deep."""
    rest = below(path, code_root)
    return F.when(rest.contains("/"), rest)


def attributable(rel: Column) -> Column:
    """Not in a generated directory, and not a leftover."""
    generated = F.arrays_overlap(F.split(rel, "/"), F.array(*map(F.lit, GENERATED)))
    leftover = F.lit(False)
    for x in LEFTOVER:
        leftover = leftover | rel.endswith(x)
    return ~generated & ~leftover


def remotely_attributable(path: Column) -> Column:
    scratch = F.lit(False)
    for x in SCRATCH:
        scratch = scratch | path.startswith(x)
    return ~scratch & attributable(path)


def memory_of(path: Column, memory_root: str) -> Column:
    """Stem of a note directly in the notes directory; patterns and the index are none."""
    stem = F.regexp_extract(below(path, memory_root), r"^([^/*?\[\]{}]+)\.md$", 1)
    return F.when((stem != "") & (stem != "MEMORY"), stem)


def looks_like_path(word: Column) -> Column:
    """Starts with ~, holds a slash, is a known bare file, or is stem.ext with 1 to 8 letters or digits."""
    return word.startswith("~") | word.contains("/") | word.isin(BARE_FILES) | word.rlike(r"^.+\.[A-Za-z0-9]{1,8}$")


def normalise(path: Column) -> Column:
    """Folds ``.``, ``..`` and empty segments of an absolute path."""
    folded = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, x: F.when((x == "") | (x == "."), acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x)),
    )
    return F.concat(F.lit("/"), F.array_join(folded, "/"))


def resolve(word: Column, cwd: Column, home: str) -> Column:
    """An absolute path for a word of a command, or null if it names no local file for certain."""
    none = word.isNull() | (word == "") | (word == "-") | word.contains("://") | word.startswith("/dev/") | word.contains("$") | word.rlike(r"^[A-Za-z0-9_.@-]+:")
    full = (
        F.when(word == "~", F.lit(home))
        .when(word.startswith("~/"), F.concat(F.lit(home + "/"), F.substr(word, F.lit(3))))
        .when(word.startswith("/"), word)
        .otherwise(F.concat(cwd, F.lit("/"), word))
    )
    return F.when(~none & full.isNotNull(), normalise(full))


def short_name(host: Column) -> Column:
    """Host up to its first dot; empty is an unknown host."""
    return F.coalesce(F.nullif(F.substring_index(host, ".", 1), F.lit("")), F.lit("unknown host"))


def machine(target: Column) -> Column:
    """Machine of an ssh target: no user, an IPv4 address whole, else the first label."""
    host = F.element_at(F.split(target, "@"), -1)
    return F.when(host.rlike(r"^[0-9]+(\.[0-9]+){3}$"), host).otherwise(F.substring_index(host, ".", 1))


def renamed_from(path: Column) -> Column:
    """Old name in ``a => b`` and ``x/{a => b}/y``; null where nothing was renamed."""
    braced = F.regexp_replace(path, r"\{(.*) => (.*)\}", "$1")
    plain = F.regexp_extract(path, r"^(.*) => (.*)$", 1)
    old = F.when(path.rlike(r"\{.* => .*\}"), braced).when(path.contains(" => "), plain)
    return F.regexp_replace(old, "//", "/")


def renamed_to(path: Column) -> Column:
    braced = F.regexp_replace(path, r"\{(.*) => (.*)\}", "$2")
    plain = F.regexp_extract(path, r"^(.*) => (.*)$", 2)
    new = F.when(path.rlike(r"\{.* => .*\}"), braced).when(path.contains(" => "), plain).otherwise(path)
    return F.regexp_replace(new, "//", "/")
