"""Secret scans: candidates of every text, told apart by how many owners the corpus shows for them.

All of it is DataFrame functions. Candidates are found by three patterns per text, with
their places in code points. Their values, as hashes, are aggregated over the corpus by
distinct repository and owner: a value that `EXAMPLE_REPOSITORIES` repositories or
`EXAMPLE_OWNERS` owners have is a widely copied example; another one that mixes letters and digits is a
live-looking credential of its owner. A live-looking value also counts where no pattern names it:
its further occurrences as a whole token, anywhere in the corpus, are added as
spans of kind `live`. Base spans always stay.

Values never leave the scan, only 64-bit hashes; counts combine before each shuffle, so an
example in a third of all rows is one row per task and repository. No text is shuffled.

Defined results: a null text is empty; without candidates n_* are 0 and spans is the empty
string; null repositories or owners do not count as one; repeated rows are reported each;
overlapping spans of different kinds all stay; an added span never overlaps a base one;
empty tables give no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coldkeep.llm.frames import joined_with
from coldkeep.session import written

EXAMPLE_REPOSITORIES = 3
EXAMPLE_OWNERS = 3
MARK = "[secret]"

#: Fixed patterns: kind, pattern, group of the value, least length of the value.
_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = (("assign", _ASSIGN, True, 6), ("access", "AKIA[A-Z0-9]+", False, 20), ("hex", "[0-9a-f]+", False, 24))
#: Tokens that may be a live value without a name before it.
_TOKEN = r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{12,}"
#: What any candidate needs; a cheap test that most texts fail.
_ANY = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"
_TOKEN_ANY = r"[A-Za-z0-9+/_.=-]{12}"

_SPAN = "array<struct<start:bigint,kind:int,end:bigint,value:bigint,mixed:boolean>>"


def _matches(text: Column, kind: int, pattern: str, valued: bool, least: int) -> Column:
    """Matches of a pattern, leftmost first and not overlapping, as spans in code points.

    The text is cut into (what precedes, match) pairs; `\\G` keeps the search from starting
    anywhere but at the end of the last match, so a text is read once.
    """
    whole = rf"\G(?s:(.*?))({pattern})"
    before = F.regexp_extract_all(text, F.lit(whole), F.lit(1))
    match = F.regexp_extract_all(text, F.lit(whole), F.lit(2))
    value = F.regexp_extract_all(text, F.lit(whole), F.lit(3)) if valued else match
    pairs = F.zip_with(before, F.arrays_zip(match.alias("m"), value.alias("v")), lambda b, m: F.struct(
        F.length(b).cast("long").alias("b"), F.length(m["m"]).cast("long").alias("n"), m["v"].alias("v")))
    empty = F.array().cast(_SPAN)

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + pair["b"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + pair["n"]).alias("end"),
                        F.xxhash64(pair["v"]).alias("value"),
                        (pair["v"].rlike("[0-9]") & pair["v"].rlike("[A-Za-z]")).alias("mixed"))
        found = F.when(F.length(pair["v"]) >= least, F.concat(state["found"], F.array(span))).otherwise(state["found"])
        return F.struct((start + pair["n"]).alias("at"), found.cast(_SPAN).alias("found"))

    return F.aggregate(pairs, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("found")), step, lambda s: s["found"])


def found_spans(docs: DataFrame, *keep: Column) -> DataFrame:
    """`keep` columns, then `spans` (base) and `tokens` (possible further occurrences) of every text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    empty = F.array().cast(_SPAN)
    base = F.array_sort(F.concat(*[_matches(text, i, p, v, n) for i, (_, p, v, n) in enumerate(KINDS)]))
    tokens = _matches(text, len(KINDS), _TOKEN, False, 12)
    return docs.select(
        *keep, F.when(text.rlike(_ANY), base).otherwise(empty).alias("spans"),
        F.when(text.rlike(_TOKEN_ANY), F.filter(tokens, lambda t: t["mixed"])).otherwise(empty).alias("tokens"))


def ownership(found: DataFrame) -> DataFrame:
    """value, repositories, owners and whether it is live-looking, for every candidate value of the corpus."""
    seen = found.select(F.explode("spans").alias("s"), "repository", "owner").select("s.value", "s.mixed", "repository", "owner")
    by_owner = seen.groupBy("value", "repository", "owner").agg(F.max("mixed").alias("mixed"))
    repositories = by_owner.groupBy("value", "repository").agg(F.max("mixed").alias("mixed")).groupBy("value").agg(
        F.count("repository").alias("repositories"), F.max("mixed").alias("mixed"))
    owners = by_owner.select("value", "owner").distinct().groupBy("value").agg(F.count("owner").alias("owners"))
    few = (F.col("repositories") < EXAMPLE_REPOSITORIES) & (F.col("owners") < EXAMPLE_OWNERS)
    return repositories.join(owners, "value").select("value", "repositories", "owners", (few & F.col("mixed")).alias("live"))


def _text_of(span: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS], F.lit("live"))
    return F.concat_ws(":", F.element_at(names, span["kind"] + 1), span["start"].cast("string"), span["end"].cast("string"))


def scan(spark: SparkSession, docs: DataFrame, repository: str = "source", owner: str = "source") -> DataFrame:
    """One row per row of `docs`: row, doc_id, text_hash, spans, added, live_spans and n_example, n_live."""
    rows = docs.withColumn("row", F.monotonically_increasing_id())
    found = written(spark, found_spans(
        rows, "row", "doc_id", F.xxhash64("text").alias("text_hash"), F.col(repository).alias("repository"), F.col(owner).alias("owner")), "spans")
    owned = written(spark, ownership(found), "owners")
    pair = F.struct("s.start", "s.kind", "s.end", "s.value", "s.mixed").cast(_SPAN[6:-1])
    told = found.filter(F.size("spans") > 0).select("row", F.explode("spans").alias("s")).select(
        "row", pair.alias("span"), F.col("s.value").alias("value")).join(owned, "value").groupBy("row").agg(
        F.sum(F.col("live").cast("long")).alias("n_live"), F.sum((~F.col("live")).cast("long")).alias("n_example"),
        F.collect_list(F.when(F.col("live"), F.col("span"))).alias("live_spans"))
    # tokens outside the base spans whose value is live somewhere
    free = F.filter("tokens", lambda t: ~F.exists("spans", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    added = found.filter(F.size("tokens") > 0).select("row", F.explode(free).alias("s")).select(
        "row", pair.alias("span"), F.col("s.value").alias("value"))
    added = added.join(owned.filter("live").select("value"), "value").groupBy("row").agg(F.collect_list("span").alias("added"))
    none = F.array().cast(_SPAN)
    return found.select("row", "doc_id", "text_hash", "spans").join(told, "row", "left").join(added, "row", "left").select(
        "row", "doc_id", "text_hash", "spans", F.coalesce("added", none).alias("added"),
        F.coalesce("live_spans", none).alias("live_spans"), F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_example", F.lit(0)).alias("n_example"))


def secrets(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per document its base counts, digest, all spans, and how many candidates are live or examples."""
    def kinds(i: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")

    base = F.concat_ws(",", F.transform("spans", _text_of))
    every = F.concat_ws(",", F.transform(F.array_sort(F.concat("spans", "added")), _text_of))
    return scan(spark, docs).select(
        "doc_id", *[kinds(i).alias(f"n_{k[0]}") for i, k in enumerate(KINDS)],
        F.sha2(base, 256).alias("base_sha256"), every.alias("spans"), "n_live", "n_example")


def mask_secrets(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents with every live-looking credential replaced by `MARK`; examples stay as they are.

    n_chars, where there is one, is counted anew for changed texts.
    """
    columns = docs.columns
    own = "_" * (1 + max(len(c) for c in columns))  # before names that no column has
    key, found = f"{own}text_hash", f"{own}cuts"
    spans = F.array_sort(F.concat("live_spans", "added"))
    # equal texts have equal cuts
    cuts = scan(spark, docs).select("text_hash", spans.alias("cuts")).filter(F.size("cuts") > 0).dropDuplicates(["text_hash"])
    cuts = written(spark, cuts.toDF(key, found), "cuts")
    keyed = docs.withColumn(key, F.xxhash64("text"))

    def step(state: Column, cut: Column) -> Column:
        new = cut["start"] >= state["at"]
        kept = F.substring(F.col("text"), (state["at"] + 1).cast("int"), F.greatest(cut["start"] - state["at"], F.lit(0)).cast("int"))
        out = F.when(new, F.concat(state["out"], kept, F.lit(MARK))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], cut["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    masked = F.aggregate(found, start, step, lambda s: F.concat(s["out"], F.substring(F.col("text"), (s["at"] + 1).cast("int"), 2147483647)))
    changed = joined_with(keyed, cuts, key, 160, "left").withColumn(
        "text", F.when(F.col(found).isNotNull(), masked).otherwise(F.col("text")))
    if "n_chars" in columns:
        changed = changed.withColumn("n_chars", F.when(F.col(found).isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return changed.select(*[F.col(f"`{c}`") for c in columns])
