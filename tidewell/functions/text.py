"""Text functions over columns (native expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Note types and link relations.
NOTE_TYPES = ["user", "feedback", "project", "reference"]
RELATIONS = ["part-of", "governs", "because", "refines", "supersedes", "contradicts"]


def tokenize(text: Column) -> Column:
    """Search terms: lower-case runs of letters and digits; a hyphen compound adds its joined form first."""
    runs = F.split(F.lower(text), r"[^\p{IsAlphabetic}\p{N}-]+")

    def terms(run: Column) -> Column:
        parts = F.filter(F.split(run, "-"), lambda p: p != "")
        compound = F.when(F.size(parts) > 1, F.concat(F.array(F.array_join(parts, "")), parts)).otherwise(parts)
        return F.when(run.contains("-"), compound).otherwise(F.filter(F.array(run), lambda p: p != ""))

    # most texts hold no hyphen, and need no more than the split
    return F.when(text.contains("-"), F.flatten(F.transform(runs, terms))).otherwise(F.filter(runs, lambda r: r != ""))


def hash_candidates(text: Column) -> Column:
    """Hex runs of 7 to 40 signs that hold a letter and stand alone."""
    return F.regexp_extract_all(text, F.lit(r"(?<![0-9A-Za-z])(?=[0-9]*[a-fA-F])[0-9a-fA-F]{7,40}(?![0-9A-Za-z])"), 0)


def names_in(text: Column) -> Column:
    """Distinct names of five or more ``[a-z0-9_]``, each followed by another sign."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![a-z0-9_])[a-z0-9_]{5,}(?=[^a-z0-9_])"), 0))


def frontmatter(raw: Column) -> Column:
    """The block between ``---`` lines at the very start; null without one."""
    found = F.regexp_extract(raw, r"(?s)^---\n(.*?)\n---", 1)
    return F.when(raw.rlike(r"(?s)^---\n.*?\n---"), found)


def body(raw: Column) -> Column:
    return F.when(frontmatter(raw).isNotNull(), F.regexp_extract(raw, r"(?s)^---\n.*?\n---\n?(.*)$", 1)).otherwise(raw)


def frontmatter_value(raw: Column, key: str) -> Column:
    """First ``key: value`` at any indent in the frontmatter, without quotes; empty is null."""
    v = F.regexp_extract(frontmatter(raw), rf"(?m)^[ \t]*{key}:[ \t]*(.*)$", 1)
    return F.nullif(F.trim(F.regexp_replace(F.trim(v), r"^[\"']+|[\"']+$", "")), F.lit(""))


def without_code(text: Column) -> Column:
    """Fenced blocks and inline code blanked out."""
    fenced = F.regexp_replace(text, r"(?ms)^(```|~~~).*?^\1[^\n]*$", " ")
    return F.regexp_replace(fenced, r"(`+)(?!`).*?(?<!`)\1(?!`)", " ")


def wikilinks(text: Column) -> Column:
    """Link inners up to the bar, white space collapsed; links in code don't count."""
    inner = F.regexp_extract_all(without_code(text), F.lit(r"\[\[([^\]\|]+)(?:\|[^\]]*)?\]\]"), 1)
    return F.transform(inner, lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))


def relation_of(inner: Column) -> Column:
    prefix = F.substring_index(inner, ":", 1)
    return F.when(prefix.isin(RELATIONS) & (F.length(inner) > F.length(prefix) + 1), prefix)


def target_of(inner: Column) -> Column:
    prefix = F.substring_index(inner, ":", 1)
    return F.when(relation_of(inner).isNotNull(), F.substr(inner, F.length(prefix) + 2)).otherwise(inner)


def index_links(index: Column) -> Column:
    """Stems of ``(x.md)`` links in order, without those that hold : or /."""
    return F.regexp_extract_all(index, F.lit(r"\]\(([^):/]+)\.md\)"), 1)


def bold_runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\*\*(.+?)\*\*"), 1)


def has_section(text: Column, heading: str) -> Column:
    """Some bold run starts with the heading (any case) and ends there or goes on with a separator."""
    return F.exists(bold_runs(text), lambda x: F.trim(x).rlike(rf"(?i)^{heading}($|[:. ,(—-])"))


def one_line(text: Column, most: int) -> Column:
    """Control and deceptive format signs become blanks, white space is collapsed, and the line cut."""
    clean = F.regexp_replace(text, "[\\p{Cc}\\u00ad\\u200b-\\u200f\\u202a-\\u202e\\u2060-\\u2069\\ufeff]", " ")
    return F.substring(F.trim(F.regexp_replace(clean, r"\s+", " ")), 1, most)


def sign(text: Column, most: int = 120) -> Column:
    """Landmark line: white space collapsed, cut with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.char_length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


# The one letter that becomes two when lowered, what it becomes, and the letter whose form
# depends on what follows it; and a mark that stands for the second of the two.
_DOTTED_I, _DOTTED_I_LOW, _SIGMA, _SIGMA_LOW, _MARK = "\u0130", "i\u0307", "\u03a3", "\u03c3", "\ue000"


def folded(text: Column) -> Column:
    """Lowered sign by sign, so that no sign's form depends on its neighbours."""
    return F.lower(F.replace(F.translate(text, _SIGMA, _SIGMA_LOW), F.lit(_DOTTED_I), F.lit(_DOTTED_I_LOW)))


def folded_at(text: Column, term: Column) -> Column:
    """The place in ``text`` (from 1, 0 if there is none) of the first hit of a lowered term, whatever its case there.

    A place in the folded text is brought back by the letters before it that became two.
    """
    at = F.call_function("instr", folded(text), term)
    marked = F.replace(text, F.lit(_DOTTED_I), F.lit(_DOTTED_I + _MARK))
    before = F.substr(marked, F.lit(1), at - 1)
    grown = F.char_length(before) - F.char_length(F.replace(before, F.lit(_DOTTED_I + _MARK), F.lit(_DOTTED_I)))
    return F.when((at > 1) & text.contains(_DOTTED_I), at - grown).otherwise(at)


def snippet(text: Column, term: Column, around: int = 80, length: Column | None = None) -> Column:
    """Text around the first hit, with ellipses where it is cut; the start if there is no hit.

    ``length`` is what the hit counts as, if not as the term's own.
    """
    at = folded_at(text, term)
    first = F.greatest(at - around, F.lit(1))
    end = F.least(at + (F.char_length(term) if length is None else length) + around, F.char_length(text) + 1)
    cut = F.replace(F.substr(text, first, end - first), F.lit("\n"), F.lit(" "))
    return F.concat(F.when(first > 1, "…").otherwise(""), cut, F.when(end <= F.char_length(text), "…").otherwise(""))


def refused_dirs(text: Column) -> Column:
    """Directories that a shell refused to change to, distinct, in order."""
    bash = F.regexp_extract_all(text, F.lit(r"(?m)cd: (.+): (?:No such file or directory|Not a directory|Permission denied)\s*$"), 1)
    zsh = F.regexp_extract_all(text, F.lit(r"(?m)cd:\d+: (?:no such file or directory|not a directory|permission denied): (.+?)\s*$"), 1)
    return F.array_distinct(F.concat(bash, zsh))


# Frameworks whose import marks Swift.
APPLE = ["Foundation", "CoreAudio", "AVFoundation", "AppKit", "UIKit", "SwiftUI", "CoreGraphics", "Cocoa"]


def is_json(text: Column) -> Column:
    """Whether the whole text is one JSON value; the parser alone is content with a value at its beginning.

    What follows the value would have to go on an array and an object alike, and nothing but white space does.
    """
    parses = lambda before, after: F.try_parse_json(F.concat(F.lit(before), text, F.lit(after))).isNotNull()
    return F.try_parse_json(text).isNotNull() & parses("[", "]") & parses('{"v":', "}")


def sniff(text: Column) -> Column:
    """Language of a text body: the first arm of an ordered list that fits."""
    head = F.regexp_replace(text, r"^\s+", "")

    def line(*marks: str) -> Column:
        out = F.lit(False)
        for m in marks:
            out = out | head.startswith(m) | text.contains("\n" + m)
        return out

    def has(m: str) -> Column:
        return text.contains(m)

    return (
        F.when(head.startswith("#!"), "a script with a shebang")
        .when(is_json(head), "JSON")
        .when(head.rlike(r"(?i)^(SELECT|CREATE|INSERT|UPDATE|DELETE|PRAGMA|ATTACH|BEGIN|WITH)(?![A-Za-z])"), "SQL")
        .when(line("theorem ", "inductive ", "@["), "Lean")
        .when(line("structure ") & has(" where"), "Lean")
        .when(text.rlike(r"(?m)^\s*def .*( := | : )"), "Lean")
        .when(text.rlike(r"(?m)^\s*import (\{|\*|.* from )") | line("export ", "const "), "TypeScript or JavaScript")
        .when(line("package ", "fun ") | has("kotlinx"), "Kotlin or Java")
        .when(text.rlike(rf"(?m)^\s*import ({'|'.join(APPLE)})\s*$"), "Swift")
        .when(text.rlike(r"(?m)^\s*import .") | text.rlike(r"(?m)^\s*from .* import ") | line("def "), "Python")
        .when((has("open(") & has(".read()")) | has(".read_text()") | has(".write_text("), "Python")
        .when(line("#[", "fn ", "pub fn "), "Rust")
        .when(head.startswith("let ") & has(" in "), "Dhall")
        .when(head.startswith("---") | line("apiVersion:"), "YAML")
        .when(head.startswith("[") & has("="), "INI")
        .when(head.startswith("<"), "markup")
        .when(head.startswith("set -e") | line("for ", "if ["), "shell")
        .otherwise("prose, or nothing recognised")
    )
