"""Directory trees as tables: listing with ignore rules, snapshots, changes between them, nodes from them."""

from __future__ import annotations

import errno
import os
import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engramite.functions.normalize import trimmed
from engramite.functions.scoring import event_confidence

MAX_FILE_BYTES, PREVIEW_BYTES = 1_000_000, 16_384
FILES = "path string, relative_path string"


@dataclass(frozen=True)
class Rule:
    """A line of an ignore file in folder ``base``."""

    base: str
    negated: bool
    folders_only: bool
    whole_path: tuple[re.Pattern, ...]
    segment: re.Pattern | None

    def matches(self, path: str, is_folder: bool) -> bool:
        rel = os.path.relpath(path, self.base)
        if rel == "." or rel.startswith("../") or (self.folders_only and not is_folder):
            return False
        if self.segment:
            return any(self.segment.fullmatch(s) for s in rel.split("/"))
        return any(p.fullmatch(rel) for p in self.whole_path)


    @property
    def regex(self) -> str | None:
        """What a file's path from ``base`` on must contain, in the words that Java's engine shares; None matches no file."""
        if self.folders_only:
            return None
        if self.segment:
            return rf"(?s)(?:^|/)(?:{self.segment.pattern.replace('.*', '[^/]*')})(?:/|$)"
        return "(?s)^(?:" + "|".join(p.pattern for p in self.whole_path) + ")$"


def _glob(pattern: str, star: str, any_one: str) -> re.Pattern:
    kinds = {"**": ".*", "*": star, "?": any_one}
    return re.compile("".join(kinds.get(x) or re.escape(x) for x in re.findall(r"\*\*|\*|\?|[^*?]+", pattern)), re.DOTALL)


def parse_rule(line: str, base: str) -> Rule | None:
    """A rule, or None for blank lines and comments.  ``!`` negates, a leading ``/`` anchors, a trailing one means folders."""
    text = line.strip()
    if not text or text.startswith("#"):
        return None
    negated = text.startswith("!")
    text = text.lstrip("!").strip() if negated else text
    bare = text.strip("/").replace("\\", "/").removeprefix("./")
    if not bare:
        return None
    anchored, folders = text.startswith("/"), text.endswith("/")
    if anchored:
        return Rule(base, negated, folders, (_glob(bare, "[^/]*", "[^/]"),), None)
    if "/" in bare:
        return Rule(base, negated, folders, (_glob(bare, "[^/]*", "[^/]"), _glob("**/" + bare, "[^/]*", "[^/]")), None)
    return Rule(base, negated, folders, (), _glob(bare, ".*", "."))


def ignored(path: str, is_folder: bool, rules: Iterable[Rule]) -> bool:
    """The last rule that matches decides."""
    out = False
    for rule in rules:
        if rule.matches(path, is_folder):
            out = not rule.negated
    return out


def ignored_files(path: Column, rules: Iterable[Rule]) -> Column:
    """The same for a column of files' paths, inside the JVM."""
    out = F.lit(False)
    for rule in rules:
        base = rule.base.rstrip("/") + "/"
        if rule.regex:
            hit = path.startswith(base) & F.substring(path, len(base) + 1, 1 << 30).rlike(rule.regex)
            out = F.when(hit, F.lit(not rule.negated)).otherwise(out)
    return out


def has_extension(path: Column, extensions: Iterable[str]) -> Column:
    """Whether a path ends in one of the extensions, told apart from case, blanks and a leading dot."""
    return extension(path).isin(*[f".{e.strip().lower().lstrip('.')}" for e in extensions if e.strip()])


def list_files(root: str, extensions: Iterable[str] | None = None, include_hidden: bool = False, follow_symlinks: bool = False, respect_gitignore: bool = True) -> list[str]:
    """Sorted regular files under ``root``.

    ``.git`` and ``.gitignore`` never count, dotfiles only if asked for; ignored folders aren't entered;
    a folder reached twice through links is listed once.
    """
    root = os.path.abspath(os.path.expanduser(root))
    wanted = None if extensions is None else {("." + e.strip().lower().lstrip(".")) for e in extensions if e.strip()}
    found: set[str] = set()
    seen: set[str] = set()

    def walk(folder: str, inherited: tuple[Rule, ...]) -> None:
        real = os.path.realpath(folder)
        if real in seen:
            return
        seen.add(real)
        rules = inherited
        if respect_gitignore and os.path.isfile(ignore := os.path.join(folder, ".gitignore")):
            with open(ignore, encoding="utf-8", errors="replace") as lines:
                rules += tuple(r for line in lines if (r := parse_rule(line, folder)))
        for entry in os.scandir(folder):
            name = entry.name
            if name in (".git", ".gitignore") or (name.startswith(".") and not include_hidden) or (entry.is_symlink() and not follow_symlinks):
                continue
            is_folder = entry.is_dir()
            if ignored(entry.path, is_folder, rules):
                continue
            if is_folder:
                walk(entry.path, rules)
            elif entry.is_file() and (wanted is None or os.path.splitext(name)[1].lower() in wanted):
                found.add(entry.path)

    if not os.path.isdir(root):
        raise NotADirectoryError(root)
    walk(root, ())
    return sorted(found)


def snapshot(spark: SparkSession, root: str, **options) -> DataFrame:
    """(path, relative_path, size, mtime_us, sig, content) of every listed file; contents are read by the executors."""
    root = os.path.abspath(os.path.expanduser(root))
    paths = list_files(root, **options)
    if not paths:
        return spark.createDataFrame([], "path string, relative_path string, size long, mtime_us long, sig string, content binary")
    paths = [p for p in paths if not _unreadable(p)]
    if not paths:
        return spark.createDataFrame([], "path string, relative_path string, size long, mtime_us long, sig string, content binary")
    raw = spark.read.format("binaryFile").load([re.sub(r"([\\{}\[\]*?])", r"\\\1", p) for p in paths])
    path = F.regexp_replace("path", "^file:/+", "/")
    return raw.select(path.alias("path"), F.substring(path, len(root) + 2, 1 << 30).alias("relative_path"), F.col("length").alias("size"), F.unix_micros("modificationTime").alias("mtime_us"), F.sha2("content", 256).alias("sig"), "content")


def diff(old: DataFrame, new: DataFrame, on: tuple[str, ...] = ("size", "sig")) -> DataFrame:
    """(path, type) of what was added, removed or modified between two snapshots; one join on the path."""
    a = old.select("path", F.struct(*on).alias("__old"))
    b = new.select("path", F.struct(*on).alias("__new"))
    both = a.join(b, "path", "full_outer")
    kind = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(~F.col("__old").eqNullSafe(F.col("__new")), "modified")
    return both.select("path", kind.alias("type")).where(F.col("type").isNotNull())


def preview(content: Column, size: Column, max_bytes: int = MAX_FILE_BYTES, read_bytes: int = PREVIEW_BYTES, reason: Column | None = None) -> Column:
    """struct(state, text): the name of the error that reading gave (``reason``, or unreadable), too_large, binary (also when the cut splits a character) or ok with the trimmed beginning."""
    start = F.substring(content, 1, read_bytes)
    ok = F.is_valid_utf8(start.cast("string"))
    state = F.when(content.isNull(), F.lit("unreadable") if reason is None else F.coalesce(reason, F.lit("unreadable"))).when(size > max_bytes, "too_large").when(ok, "ok").otherwise("binary")
    return F.struct(state.alias("state"), F.when(state == "ok", trimmed(start.cast("string"))).otherwise("").alias("text"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def event_nodes(events: DataFrame, max_bytes: int = MAX_FILE_BYTES, read_bytes: int = PREVIEW_BYTES) -> DataFrame:
    """A node for every event (type, path, relative_path, size, mtime_us, content), removals included; earlier nodes stay."""
    seen = events.withColumn("__p", preview(F.col("content"), F.col("size"), max_bytes, read_bytes))
    removed = F.col("type") == "removed"
    head = F.concat(F.lit("[filesystem "), F.col("type"), F.lit("] "), F.col("relative_path"))
    text = F.when(removed | (F.col("__p.text") == ""), head).otherwise(F.concat(head, F.lit("\n\n"), F.col("__p.text")))
    state = F.when(removed, "removed").otherwise(F.col("__p.state"))
    about = F.to_json(F.struct(F.lit("filesystem").alias("source"), F.col("type").alias("event_type"), "path", "relative_path", extension(F.col("path")).alias("extension"), "size", F.col("mtime_us").alias("mtime"), state.alias("read_state")))
    key = F.md5(F.concat_ws("|", "type", "path", F.col("mtime_us").cast("string"), "size"))
    return seen.select(
        F.concat(F.lit("node_"), key).alias("id"), text.alias("content"), F.lit("episodic").alias("node_type"), event_confidence(F.col("type")).alias("confidence"),
        F.lit("filesystem").alias("source"), about.alias("metadata"), state.alias("read_state"),
    )


def scan_directory(spark: SparkSession, root: str, **options) -> tuple[DataFrame, dict[str, int]]:
    """Nodes for all files under ``root`` as additions, and the summary of the scan."""
    events = snapshot(spark, root, **options).withColumn("type", F.lit("added"))
    nodes = event_nodes(events)
    found, gone = list_files(root, **options), {r.path for r in events.select("path").collect()}
    errors = [{"path": p, "reason": why} for p in found if (why := _unreadable(p)) or p not in gone]
    return nodes, {"files_discovered": len(found), "files_ingested": len(found) - len(errors), "files_failed": len(errors), "errors": errors}


def _unreadable(path: str) -> str | None:
    """The name of the error that opening a file gives."""
    try:
        with open(path, "rb"):
            return None
    except OSError as error:
        return errno.errorcode.get(error.errno or 0, "unreadable").lower()


def summary(files: DataFrame) -> DataFrame:
    """The tallies of a scan over (path, reason), a reason being why a file couldn't be ingested."""
    return files.agg(F.count(F.lit(1)).alias("files_discovered"), F.count(F.when(F.col("reason").isNull(), 1)).alias("files_ingested"), F.count("reason").alias("files_failed"))
