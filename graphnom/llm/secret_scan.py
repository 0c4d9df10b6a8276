"""Secret scan with built-in SQL functions only.

Base kinds (assign, access, hex) are found by pattern in whole texts. The method looks at the corpus: every
candidate value is hashed, and its hash is counted over distinct repositories and, apart from those, distinct owners.
A value that many of them hold is a widely copied example; one that few hold looks like a live credential of its
owner. Beside the base kinds, long mixed tokens are candidates; those that are owner-specific are added as spans of
kind `token`, those that are widely copied are not. Base spans are never dropped; each is told apart as live or
example.

Spans are code points, end exclusive. Starts come from running sums over the lengths of what lies between matches
(split) and of the matches themselves (regexp_extract_all), so the scan stays inside the built-in functions. Its steps
are single expressions over arrays: their cost grows with a text's length and its number of spans, not with its square.

Defined cases: a null text is empty and has no spans; null repositories or owners count as one of their own
name; spans are ordered by start, then kind (spans of one kind never share a start); a very long text is scanned
whole, and a token of any length is found; repeated rows give repeated results, and copies in one repository count
once; an empty table gives an empty result; extra columns are ignored, clashing names do no harm (working columns
start with `_`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

# The base kinds' patterns, and the least length of the group that counts.
PATTERNS = [
    ("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
    ("access", r"(AKIA[A-Z0-9]+)", 20),
    ("hex", r"([0-9a-f]{24,})", 24),
]
#: What the method adds: long runs of these characters that mix upper case, lower case and digits.
TOKEN, TOKEN_LEAST = r"(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]{28,})", 28
TOKEN_CLASSES = ("[0-9]", "[a-z]", "[A-Z]")
KINDS = ["assign", "access", "hex", "token"]
#: A value found in so many distinct repositories, and with so many distinct owners, is an example.
EXAMPLE_REPOSITORIES = 5
EXAMPLE_OWNERS = 5
#: A value that stands in more than one in so many of all places is hot; there are at most so many of those, which
#: bounds their broadcast.
HOT = 1000
#: Elements of an array that running sums go over at a time.
STRIDE = 256
#: More than any place in a text.
FAR = (1 << 31) - 1
LIVE_MARK, EXAMPLE_MARK = "<SECRET>", "<EXAMPLE>"
SPAN = "struct<start:int,end:int,place:int,value:string>"


def in_blocks(values: Column) -> Column:
    """An array as an array of its blocks of STRIDE elements."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(values) / STRIDE) - 1, F.lit(0)).cast("int")), lambda b: F.slice(values, b * STRIDE + 1, STRIDE))


def larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each element of an int array, what `join` makes of 0 and all before it. Goes in blocks of STRIDE elements,
    as adding to an array copies it."""
    blocks = in_blocks(values)

    def inside(block: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(block, start, lambda s, v: F.struct(join(s["at"], v).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    zero = F.lit(0)
    firsts = inside(F.transform(blocks, lambda b: F.aggregate(b, zero, join)), zero)
    return F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), firsts.alias("f")), lambda x: inside(x["b"], x["f"])))


def matches(text: Column, pattern: str, least: int, grouped: bool) -> tuple[Column, Column, Column]:
    """Of the non-overlapping matches: lengths of the texts before, between and after them, the matches, and their
    groups; empty arrays where there is none."""
    none = F.array().cast("array<string>")
    there = F.rlike(text, F.lit(pattern))
    whole = F.when(there, F.regexp_extract_all(text, F.lit(pattern), F.lit(0 if grouped else 1))).otherwise(none)
    group = F.when(there, F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).otherwise(none) if grouped else whole
    return F.when(there, F.transform(F.split(text, pattern, -1), F.length)).otherwise(F.array().cast("array<int>")), whole, group


def with_spans(df: DataFrame, out: str, kind: str, pattern: str, least: int) -> DataFrame:
    """df (_text) with `out`: an array of SPAN of the matches whose group is long enough."""
    gaps, whole, group = matches(F.col("_text"), pattern, least, kind == "assign")
    df = df.withColumns({"_gaps": gaps, "_w": whole, "_g": group})
    # a match starts after all before it and the gaps up to it
    steps = F.zip_with("_gaps", F.transform("_w", F.length), lambda g, n: g + F.coalesce(n, F.lit(0)))
    df = df.withColumn("_begin", running(steps, lambda a, b: a + b))
    # zipped, not looked up by place: an expression inside a lambda is evaluated for each element
    zipped = F.arrays_zip(F.col("_begin").alias("b"), F.col("_gaps").alias("p"), F.col("_w").alias("w"), F.col("_g").alias("g"))
    row = F.transform(F.filter(zipped, lambda x: x["w"].isNotNull()), lambda x: F.struct((x["b"] + x["p"]).alias("start"), x["g"].alias("value"), F.length(x["w"]).alias("n")))
    spans = F.transform(F.filter(row, lambda s: F.length(s["value"]) >= least), lambda s: F.struct(s["start"].alias("start"), (s["start"] + s["n"]).alias("end"), F.lit(KINDS.index(kind)).alias("place"), s["value"].alias("value")))
    return df.withColumn(out, spans.cast(f"array<{SPAN}>")).drop("_gaps", "_w", "_g", "_begin")


def shown(spans: Column) -> Column:
    """kind:start:end, comma-joined, of spans sorted by start, then kind, then end."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(names, s["place"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def in_order(spans: Column) -> Column:
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["place"].alias("place"), s["end"].alias("end"), s["value"].alias("value")))
    return F.array_sort(keyed)


def scan(docs: DataFrame, repository: str = "doc_id", owner: str = "source", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep`; _base and _all: sorted spans (start, place, end, value), live: whether the value
    looks owner-specific, for each span of _all. repository, owner: columns of what a value is counted over."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00"))
    found = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("_text"), name(repository).alias("_repo"), name(owner).alias("_owner"))
    for kind, pattern, least in PATTERNS:
        found = with_spans(found, f"_{kind}", kind, pattern, least)
    found = with_spans(found, "_token", "token", TOKEN, TOKEN_LEAST).drop("_text")
    mixed = F.filter("_token", lambda s: F.rlike(s["value"], F.lit(TOKEN_CLASSES[0])) & F.rlike(s["value"], F.lit(TOKEN_CLASSES[1])) & F.rlike(s["value"], F.lit(TOKEN_CLASSES[2])))
    found = found.withColumn("_found", in_order(F.concat("_assign", "_access", "_hex", mixed))).drop("_assign", "_access", "_hex", "_token")
    # a token that overlaps a base span is that span again: in order of starts, one whose end is past the token's start
    # stands before it, or one that starts before the token's end stands after it
    token = KINDS.index("token")
    found = found.withColumn("_past", running(F.transform("_found", lambda s: F.when(s["place"] < token, s["end"]).otherwise(0)), larger))
    backward = F.reverse(F.transform("_found", lambda s: F.when(s["place"] < token, FAR - s["start"]).otherwise(0)))
    found = found.withColumn("_next", F.reverse(running(backward, larger)))
    zipped = F.arrays_zip(F.col("_found").alias("s"), F.col("_past").alias("past"), F.col("_next").alias("next"))
    free = F.transform(F.filter(zipped, lambda x: (x["s"]["place"] < token) | ((x["past"] <= x["s"]["start"]) & (x["next"] <= FAR - x["s"]["end"]))), lambda x: x["s"])
    found = C.materialise(found.withColumn("_found", free).drop("_past", "_next").withColumn("_row", F.monotonically_increasing_id()))
    one = found.where(F.size("_found") > 0).select("_row", "_repo", "_owner", F.posexplode("_found").alias("_k", "_s"))
    one = one.select("_row", "_repo", "_owner", "_k", F.xxhash64("_s.value", F.lit(1)).alias("_h1"), F.sha2("_s.value", 256).substr(1, 16).alias("_h2"))
    held = one.groupBy("_h1", "_h2", "_repo", "_owner").agg(F.count("*").alias("_n"))  # a value held a million times in one place is one row from here
    spread = held.groupBy("_h1", "_h2").agg(F.count_distinct("_repo").alias("_repos"), F.count_distinct("_owner").alias("_owners"), F.sum("_n").alias("_n"))
    # what is not an example is live, so only examples are looked up, and hot values by themselves
    examples = C.materialise(spread.where((F.col("_repos") >= EXAMPLE_REPOSITORIES) & (F.col("_owners") >= EXAMPLE_OWNERS)).select("_h1", "_h2", "_n", F.lit(True).alias("_example")))
    every = held.agg(F.sum("_n")).first()[0] or 0
    hot = F.col("_n") * HOT > every
    few = examples.where(hot).select("_h1", "_h2", F.col("_example").alias("_hot"))
    judged = one.join(F.broadcast(few), ["_h1", "_h2"], "left").where("_hot")
    rest = one.join(F.broadcast(few), ["_h1", "_h2"], "left_anti").join(examples.where(~hot).drop("_n").hint("merge"), ["_h1", "_h2"], "left")
    marks = judged.select("_row", "_k", F.lit(True).alias("_example")).union(rest.where("_example").select("_row", "_k", "_example"))
    marks = marks.groupBy("_row").agg(F.collect_set("_k").alias("_copied"))
    # only rows with candidates go through the shuffle
    with_some = found.where(F.size("_found") > 0).join(marks.hint("merge"), "_row", "left")
    joined = with_some.unionByName(found.where(F.size("_found") == 0).withColumn("_copied", F.lit(None).cast("array<int>")))

    def of_block(b: Column, copied: Column) -> Column:
        own = F.filter(copied, lambda c: (c >= F.get(b, F.lit(0))["k"]) & (c < F.get(b, F.lit(0))["k"] + STRIDE))
        field = lambda x, n: x["s"][n].alias(n)
        told = F.transform(F.array(own), lambda few: F.transform(b, lambda x: F.struct(*[field(x, n) for n in ("start", "place", "end", "value")], (~F.array_contains(few, x["k"])).alias("live"))))
        return F.get(told, F.lit(0))

    numbered = F.transform("_found", lambda s, k: F.struct(s.alias("s"), k.alias("k")))
    joined = joined.withColumn("_copied", F.coalesce("_copied", F.array().cast("array<int>")))
    marked = F.flatten(F.transform(in_blocks(numbered), lambda b: of_block(b, F.col("_copied"))))
    joined = joined.select(*keep, marked.alias("_all"))
    return joined.withColumn("_all", F.filter("_all", lambda s: (s["place"] < token) | s["live"])).withColumn("_base", F.filter("_all", lambda s: s["place"] < token))


def report(docs: DataFrame, **options) -> DataFrame:
    """Counts of each base kind, the base spans' digest, all spans, and how many are live or examples."""
    r = scan(docs, **options)
    count = lambda kind: F.size(F.filter("_base", lambda s: s["place"] == KINDS.index(kind))).cast("long")
    return r.select(
        *[c for c in r.columns if not c.startswith("_")],
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(shown(F.col("_base")), 256).alias("base_sha256"),
        shown(F.col("_all")).alias("spans"),
        F.size(F.filter("_all", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("_all", lambda s: ~s["live"])).cast("long").alias("n_example"),
    )


def redact(docs: DataFrame, **options) -> DataFrame:
    """docs with every secret's value replaced by a mark that tells live ones from copied examples; n_chars, if
    it is a column, is the new length. Of values that overlap, the first is replaced (of equal starts the shorter), and
    of the others what it leaves."""
    rows = scan(C.packed(docs), keep=("_doc",), **options)
    text = F.coalesce(F.col("_doc.text"), F.lit(""))
    values = F.array_sort(F.transform("_all", lambda s: F.struct((s["end"] - F.length(s["value"])).alias("start"), s["end"].alias("end"), s["live"].alias("live"))))
    rows = rows.withColumn("_values", values)
    rows = rows.withColumn("_past", running(F.transform("_values", lambda s: s["end"]), larger))
    # what stands between the values, and a mark for each that an earlier one does not cover; a block's values are cut
    # out of the block's own part of the text
    rows = rows.withColumn("_blocks", in_blocks(F.arrays_zip(F.col("_values").alias("s"), F.col("_past").alias("past"))))

    def piece(part: Column, first: Column, x: Column) -> Column:
        between = F.substring(part, x["past"] - first + 1, F.greatest(x["s"]["start"] - x["past"], F.lit(0)))
        return F.concat(between, F.when(x["s"]["end"] <= x["past"], F.lit("")).when(x["s"]["live"], F.lit(LIVE_MARK)).otherwise(F.lit(EXAMPLE_MARK)))

    def of_block(b: Column) -> Column:
        first, last = F.get(b, F.lit(0))["past"], F.array_max(F.transform(b, lambda x: F.greatest(x["s"]["end"], x["past"])))
        part = F.transform(F.array(F.substring(text, first + 1, last - first)), lambda p: F.array_join(F.transform(b, lambda x: piece(p, first, x)), ""))
        return F.get(part, F.lit(0))

    pieces = F.transform("_blocks", of_block)
    end = F.coalesce(F.array_max(F.transform("_values", lambda s: s["end"])), F.lit(0))
    rebuilt = F.concat(F.array_join(pieces, ""), F.substring(text, end + 1, F.length(text)))
    new = {"text": rebuilt}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(rebuilt).cast(docs.schema["n_chars"].dataType)
    own = lambda c: F.col("_doc").getField(c)
    return rows.select(*[F.when(F.size("_all") > 0, new[c]).otherwise(own(c)).alias(c) if c in new else own(c).alias(c) for c in docs.columns])
