r"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Every text is matched against the base kinds (assign, access, hex) and against a wide pattern for
long mixed tokens.  The hashes of all found values are aggregated over the corpus by distinct
owners and repositories.  A value that more than a share of all owners have, or that stands in more
than a share of all repositories, is a widely copied example; one that stays with a few of both is a
live-looking credential.  Base spans always stay; the wide pattern's live-looking values are added to
them as kind ``live``.

Positions come from cutting the text at the matches: lengths of gaps and matches sum up to them.

Defined results: a null text counts as empty; a null owner or repository is one of its own; rows
that repeat give repeated results; spans may overlap across kinds; an empty table gives an empty
result; texts of any length are scanned whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitweave.llm.common import materialize, small

# The base kinds, in the order of the contract, then the wide pattern.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
WIDE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "live")
#: A value is a copied example beyond this share of all owners, or of all repositories (but not with a single owner, or up to two repositories).
OWNERS_SHARE, REPOS_SHARE = 0.1, 0.05
#: A wide value needs digits, letters and so many different characters.
MIN_DISTINCT = 10

SPAN = "struct<start:int,kind:int,end:int,hash:bigint>"
_NONE = f"cast(array() as array<{SPAN}>)"


#: Lengths are summed up in blocks of so many, so that a text with very many matches stays cheap.
BLOCK = 128


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: expressions inside a lambda are evaluated each time they occur."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, b: a + b)


def _spans(text: Column, pattern: str, kind: int, value_group: int, keep) -> Column:
    """The spans of all matches that pass ``keep(value)``; their offsets are code points."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), value.alias("value"))

    def places(p: Column, lengths: Column, blocks: Column) -> Column:
        def place(x: Column, i: Column) -> Column:
            block = F.floor(i / BLOCK).cast("int")
            end = _sum(F.slice(blocks, F.lit(1), block)) + _sum(F.slice(lengths, block * BLOCK + 1, i - block * BLOCK + 1))
            return F.struct(
                (end - F.char_length(x["whole"])).cast("int").alias("start"),
                F.lit(kind).alias("kind"),
                end.cast("int").alias("end"),
                F.xxhash64(x["value"]).alias("hash"),
                x["value"].alias("value"),
            )

        return F.transform(p, place)

    def blocks_of(lengths: Column) -> Column:
        many = F.ceil(F.size(lengths) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), many - 1), lambda b: _sum(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))))

    # The place reached after each gap and match; the last gap has no match.
    length = lambda x: F.char_length(x["gap"]) + F.coalesce(F.char_length(x["whole"]), F.lit(0))
    found = _let(parts, lambda p: _let(F.transform(p, length), lambda n: _let(blocks_of(n), lambda b: places(p, n, b))))
    found = F.filter(found, lambda s: s["value"].isNotNull() & keep(s["value"]))
    return F.transform(found, lambda s: F.struct(s["start"], s["kind"], s["end"], s["hash"]))


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start, then kind."""
    none = F.expr(_NONE)
    assign = F.when(text.rlike(ASSIGN), _spans(text, ASSIGN, 0, 2, lambda v: F.length(v) >= 6)).otherwise(none)
    access = F.when(text.contains("AKIA"), _spans(text, ACCESS, 1, 0, lambda v: F.lit(True))).otherwise(none)
    hexes = F.when(text.rlike(HEX), _spans(text, HEX, 2, 0, lambda v: F.lit(True))).otherwise(none)
    return F.array_sort(F.concat(assign, access, hexes))


def wide_spans(text: Column, base: Column) -> Column:
    """The long mixed tokens of a text that touch no base span."""
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(v, ""))) > MIN_DISTINCT)
    wide = F.when(text.rlike(WIDE), _spans(text, WIDE, 3, 0, mixed)).otherwise(F.expr(_NONE))
    return F.filter(wide, lambda w: ~F.exists(base, lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))


def ownership(found: DataFrame) -> DataFrame:
    """hash, owners, repos: over how many distinct ones each value is spread (found: hash, owner, repo)."""
    rows = found.select("hash", F.xxhash64(F.col("owner").isNull(), "owner").alias("owner"), F.xxhash64("owner", F.col("repo").isNull(), "repo").alias("repo"))
    return rows.groupBy("hash").agg(F.countDistinct("owner").alias("owners"), F.countDistinct("repo").alias("repos"))


def _numbered(df: DataFrame, owner: Column, repo: Column, text_col: str, keep: list[str]) -> DataFrame:
    """Columns c0, c1, ... for ``keep``, then __row, __owner, __repo, __base and __wide; written once."""
    rows = df.select(
        *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"),
        owner.alias("__owner"),
        repo.alias("__repo"),
        F.monotonically_increasing_id().alias("__row"),
    )
    rows = rows.withColumn("__base", base_spans(F.col("__text"))).withColumn("__wide", wide_spans(F.col("__text"), F.col("__base")))
    return materialize(rows.drop("__text"), "secrets")


def copied(each: DataFrame, rows: DataFrame) -> DataFrame:
    """The hashes of the values that are copied widely; each: hash, owner, repo of every span, rows: __owner and __repo of every row."""
    all_of = ownership(rows.select(F.lit(0).cast("long").alias("hash"), F.col("__owner").alias("owner"), F.col("__repo").alias("repo"))).first()
    owners, repos = (all_of["owners"], all_of["repos"]) if all_of else (0, 0)
    wide = (F.col("owners") > max(1.0, OWNERS_SHARE * owners)) | (F.col("repos") > max(2.0, REPOS_SHARE * repos))
    return materialize(ownership(each).filter(wide).select("hash"), "copied")


def _verdicts(rows: DataFrame) -> DataFrame:
    """For each row with spans: live and example counts of all spans, and the live ones of the wide pattern."""
    each = rows.filter("size(__base) + size(__wide) > 0").select(
        "__row", F.col("__owner").alias("owner"), F.col("__repo").alias("repo"), F.explode(F.concat("__base", "__wide")).alias("s")
    )
    each = each.select("__row", "owner", "repo", "s", F.col("s.hash").alias("hash"))
    frequent = copied(each, rows)
    # only widely copied values are joined, so that none of them gathers its rows in one task
    frequent = small(frequent.withColumn("__copied", F.lit(True)), frequent.count())
    judged = each.join(frequent, "hash", "left").withColumn("live", F.col("__copied").isNull())
    return judged.groupBy("__row").agg(
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live")).alias("n_example"),
        F.collect_list(F.when(F.col("live") & (F.col("s.kind") == 3), F.col("s"))).alias("__added"),
    )


def find_secrets(df: DataFrame, owner: Column, repo: Column, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, base and spans (arrays of start, kind, end, hash), n_live and n_example for every row."""
    rows = _numbered(df, owner, repo, text_col, list(keep))
    own = [F.col(f"c{i}").alias(c) for i, c in enumerate(keep)]
    out = rows.join(materialize(_verdicts(rows), "verdicts"), "__row", "left")
    added = F.coalesce("__added", F.expr(_NONE))
    return out.select(
        *own,
        F.col("__base").alias("base"),
        F.array_sort(F.concat("__base", added)).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_example", F.lit(0)).alias("n_example"),
    )


def as_text(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with each run of overlapping spans replaced by ``mark``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], gap).otherwise(acc["out"]).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(text)


def redact(df: DataFrame, owner: Column, repo: Column, text_col: str = "text") -> DataFrame:
    """``df`` with base and live-looking spans replaced; every row is kept, copied examples of the wide pattern too.

    Only rows that hold wide candidates need the corpus-wide verdict, and only these are shuffled.
    """
    names = df.columns
    rows = _numbered(df, owner, repo, text_col, names)
    text = f"c{names.index(text_col)}"
    hard = F.size("__wide") > 0
    spans = F.array_sort(F.concat("__base", F.coalesce("__added", F.expr(_NONE))))
    plain = rows.filter(~hard).withColumn(text, redacted(F.col(text), F.col("__base")))
    verdicts = materialize(_verdicts(rows).filter("size(__added) > 0").select("__row", "__added"), "added")
    judged = rows.filter(hard).join(verdicts, "__row", "left").withColumn(text, redacted(F.col(text), spans))
    own = [F.col(f"c{i}").alias(c) for i, c in enumerate(names)]
    return plain.select(own).unionByName(judged.select(own))
