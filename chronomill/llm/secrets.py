"""Secret scans with DataFrame functions: fixed shapes, and a character Markov model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import free_names, hashed_sample, quoted, text_or_empty

#: Shapes in the order in which kinds are listed: name, pattern, group whose length counts, least length.
SHAPES = (
    (
        "assign",
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: The same matches found faster: runs that are long enough, since a run is always taken whole.
_SEARCHED = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
KINDS = [s[0] for s in SHAPES] + ["markov"]

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
_SIZE = len(ALPHABET) + 1
#: Numbers of the characters that join parts of a run.
_JOINTS = {ALPHABET.index(c) + 1 for c in "=/_-"}


def bound(column: Column, use) -> Column:
    """`use` of `column`, which is computed once however often `use` names it."""
    return F.element_at(F.transform(F.array(column), use), 1)


def running(values: Column, zero: Column, add, block: int = 256) -> Column:
    """The running totals of an array by `add`, an associative function with `zero` as its neutral element.

    A growing list is copied with each element, so lists grow within blocks only, which are put together afterwards.
    """
    none = F.slice(F.array(zero), 1, 0)

    def grown(list_: Column, inclusive: bool) -> Column:
        start = F.struct(zero.alias("at"), none.alias("out"))

        def step(s, x):
            total = add(s["at"], x)
            return F.struct(total.alias("at"), F.concat(s["out"], F.array(total if inclusive else s["at"])).alias("out"))

        return F.aggregate(list_, start, step, lambda s: s["out"])

    def joined(values: Column) -> Column:
        last = F.floor(F.greatest(F.size(values) - 1, F.lit(0)) / block).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(values, b * block + 1, block))
        inner = F.transform(blocks, lambda x: grown(x, True))
        ends = lambda x: F.transform(x, lambda list_: F.coalesce(F.try_element_at(list_, F.lit(-1)), zero))
        both = lambda x: F.zip_with(x, grown(ends(x), False), lambda list_, at: F.transform(list_, lambda v: add(at, v)))
        return F.flatten(bound(inner, both))

    return bound(values, joined)


def found_spans(text: Column, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, end, match>> of the leftmost non-overlapping matches; code points, end exclusive.

    The parts between the matches give the places: a match ends after the parts and matches up to it.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = lambda hits: F.transform(hits, lambda h: F.length(h))
    checked = sizes if group == 0 else lambda hits: sizes(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))
    gaps = F.slice(F.transform(F.split(text, pattern, -1), lambda x: F.length(x)), F.lit(1), F.lit(2**31 - 1))

    def placed(hits):
        steps = F.zip_with(gaps, sizes(hits), lambda gap, n: gap + F.coalesce(n, F.lit(0)))  # the part behind the last match has none
        ends = F.slice(running(steps, F.lit(0), lambda a, b: a + b), F.lit(1), F.size(hits))
        spans = F.zip_with(hits, ends, lambda h, e: F.struct((e - F.length(h)).alias("start"), e.alias("end"), h.alias("match")))
        kept = F.zip_with(spans, checked(hits), lambda s, c: F.when(c >= least, s))
        return F.filter(kept, lambda s: s.isNotNull())

    empty = F.array().cast("array<struct<start:int,end:int,match:string>>")
    return F.when(F.regexp_like(text, F.lit(pattern)), bound(hits, placed)).otherwise(empty)


def transition_counts(samples: DataFrame) -> DataFrame:
    """n by (label, pair) over all neighbouring characters of `samples` (label, sample).

    Pairs are numbered by the alphabet, characters outside it share a number, so there are at most
    labels x 68 x 68 rows.
    """
    chars = F.split("sample", "")
    code = lambda c: F.instr(F.lit(ALPHABET), c)
    pairs = F.transform(
        F.sequence(F.lit(1), F.size(chars) - 1), lambda i: code(F.element_at(chars, i)) * _SIZE + code(F.element_at(chars, i + 1))
    )
    return (
        samples.where(F.length("sample") > 1)
        .select("label", F.explode(pairs).alias("pair"))
        .groupBy("label", "pair")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def log_ratios(counts: dict[str, dict[int, int]], smoothing: float = 0.5) -> list[float]:
    """log P(next | char, random) - log P(next | char, ordinary) for every pair of characters."""
    import math

    logs = {}
    for label in ("random", "ordinary"):
        n = counts.get(label, {})
        logs[label] = []
        for a in range(_SIZE):
            row = [n.get(a * _SIZE + b, 0) + smoothing for b in range(_SIZE)]
            logs[label] += [math.log(x / sum(row)) for x in row]
    return [round(r - o, 5) for r, o in zip(logs["random"], logs["ordinary"])]


def random_samples(spark: SparkSession, rows: int = 6_000) -> DataFrame:
    """Labelled random strings: hexadecimal, base64 and alphanumeric, from hashes of consecutive numbers; they depend on nothing else."""
    made = spark.range(rows).select("id", F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 256).alias("h"))
    b64 = F.base64(F.unhex("h"))
    shown = (
        F.when(F.col("id") % 4 == 0, F.substring("h", 1, 40))
        .when(F.col("id") % 4 == 1, F.substring(b64, 1, 40))
        .when(F.col("id") % 4 == 2, F.upper(F.regexp_replace(b64, "[^A-Za-z0-9]", "")))
        .otherwise(F.regexp_replace(b64, "[^A-Za-z0-9]", ""))
    )
    return made.select(F.lit("random").alias("label"), shown.alias("sample"))


#: Parts of ordinary identifiers.
_PARTS = "get set make build parse read write load save find item user name value count index list map key node file path data time date size type text page row column table query result config version release model layer batch token word line number total average config http html json utf8 sha256 md5 base64 x86 v1 v2 2023 2024 01 10 100 test main part section chapter".split()


def ordinary_samples(docs: DataFrame, sample_docs: int = 1_500) -> DataFrame:
    """Labelled ordinary strings: long words of about `sample_docs` documents, a third of them in capitals and
    a third in camel case as well, and compound identifiers, constants, paths and numbers.

    Words with a digit are left out, since a sample of the corpus may itself hold secrets.
    """
    spark = docs.sparkSession
    texts = hashed_sample(docs, sample_docs).select(text_or_empty().alias("text"))
    words = texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z][A-Za-z_-]{7,40}"), F.lit(0))).alias("sample"))
    parts = F.split(F.lit(" ".join(_PARTS)), " ")
    pick = lambda k: F.element_at(parts, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(_PARTS))) + 1).cast("int"))
    shouted = words.where(F.pmod(F.xxhash64("sample"), F.lit(3)) == 0).select(F.upper("sample").alias("sample"))
    joined = words.where(F.pmod(F.xxhash64("sample"), F.lit(3)) == 1).select(F.concat(F.lower("sample"), F.initcap("sample")).alias("sample"))
    number = F.pmod(F.xxhash64("id", F.lit(5)), F.element_at(F.array(*[F.lit(10**n) for n in range(2, 13)]), F.pmod(F.col("id"), F.lit(11)).cast("int") + 1))
    made = spark.range(12_000).select(
        F.when(F.col("id") % 6 == 0, F.concat_ws("_", pick(1), pick(2), pick(3)))
        .when(F.col("id") % 6 == 1, F.concat(pick(1), F.initcap(pick(2)), F.initcap(pick(3))))
        .when(F.col("id") % 6 == 2, F.concat_ws("-", pick(1), pick(2), pick(3), pick(4)))
        .when(F.col("id") % 6 == 3, F.upper(F.concat_ws("_", pick(1), pick(2), pick(3))))
        .when(F.col("id") % 6 == 4, F.concat(pick(1), F.lit("/"), pick(2), F.lit("/"), pick(3), F.lit("="), pick(4)))
        .otherwise(F.concat_ws("-", pick(1), number.cast("string"), pick(2)))
        .alias("sample")
    )
    return words.union(shouted).union(joined).union(made).select(F.lit("ordinary").alias("label"), "sample")


def fit(docs: DataFrame, sample_docs: int = 1_500) -> list[float]:
    """Pair scores from labelled samples; the counts that reach the driver are bounded by the alphabet.

    Only doc_id and text are read. Null texts count as empty; without any words the made identifiers alone stand for what is ordinary.
    """
    samples = random_samples(docs.sparkSession).union(ordinary_samples(docs, sample_docs))
    counts: dict[str, dict[int, int]] = {}
    for r in transition_counts(samples).collect():
        counts.setdefault(r["label"], {})[r["pair"]] = r["n"]
    return log_ratios(counts)


def likelihood_ratio(sample: Column, ratios: list[float], stretch: int = 16, block: int = 4_096) -> Column:
    """Highest mean log-likelihood ratio per transition of any `stretch` neighbouring characters (of all, in a
    shorter sample): above 0 the random model explains that stretch better, however ordinary the rest is.

    A transition from or to one of = / _ - joins parts and is no evidence of randomness: it counts 0 at most. A long
    sample is looked through in blocks, each with the characters behind it that its last stretches need.
    """
    held = [min(r, 0.0) if _JOINTS & {i // _SIZE, i % _SIZE} else r for i, r in enumerate(ratios)]
    table = F.split(F.lit(",".join(map(str, held))), ",").cast("array<double>")
    pairs = lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.element_at(table, F.element_at(c, i) * _SIZE + F.element_at(c, i + 1) + 1))
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(float("-inf")).alias("best"))

    def best(part):
        width = F.least(F.lit(stretch), F.length(part)) - 1
        codes = F.transform(F.split(part, ""), lambda c: F.instr(F.lit(ALPHABET), c))

        def add(x, n):
            def step(s, i):
                total = s["sum"] + F.element_at(x, i) - F.when(i > n, F.element_at(x, F.greatest(i - n, F.lit(1)))).otherwise(0.0)
                return F.struct(total.alias("sum"), F.when(i >= n, F.greatest(s["best"], total)).otherwise(s["best"]).alias("best"))

            return F.aggregate(F.sequence(F.lit(1), F.size(x)), zero, step, lambda s: s["best"] / n)

        return bound(codes, lambda c: bound(pairs(c), lambda x: add(x, width)))

    def blocks(parts):
        behind = F.slice(parts, F.lit(2), F.size(parts))
        whole = F.zip_with(parts, behind, lambda p, n: F.concat(p, F.coalesce(F.substring(n, 1, stretch - 1), F.lit(""))))
        return F.filter(whole, lambda x, i: (i == 0) | (F.length(x) >= stretch))

    cut = bound(F.regexp_extract_all(sample, F.lit(f"(?s).{{1,{block}}}"), F.lit(0)), blocks)
    parts = F.when(F.length(sample) > block, cut).otherwise(F.array(sample))
    return F.when(F.length(sample) > 1, F.array_max(F.transform(parts, best))).otherwise(0.0)


def scanned(docs: DataFrame, ratios: list[float], threshold: float = 0.8) -> DataFrame:
    """All columns of `docs`, base_spans and spans: arrays of (start, end, kind) by start, then kind.

    Base spans are the matches of SHAPES. The model adds runs of 16 or more token characters that
    hold a letter, touch no base span, and have a stretch of 16 characters whose mean log-likelihood
    ratio is above `threshold`; the span is the whole run. Null text counts as empty and has no spans. Where `docs` has
    columns of these names, the new ones get an underscore more (see `free_names`). Time and memory of a text
    grow with its length and its matches, also with very many of them.
    """
    text = text_or_empty()
    base_name, name = free_names(docs.columns, "base_spans", "spans")
    kinds = F.array(*[F.lit(k) for k in KINDS])
    # By start, then kind as listed, as structs compare.
    ranked = lambda spans, rank: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end")))
    named = lambda spans: F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(kinds, s["rank"] + 1).alias("kind"))
    )
    shapes = [ranked(found_spans(text, _SEARCHED.get(k, p), g, n), i) for i, (k, p, g, n) in enumerate(SHAPES)]
    base, runs = F.array_sort(F.concat(*shapes)), found_spans(text, CANDIDATE, 0, 16)

    def added(base, runs):
        last = len(SHAPES)
        free = F.filter(_apart(base, runs), lambda r: F.regexp_like(r["match"], F.lit("[A-Za-z]")))
        random = F.filter(free, lambda r: likelihood_ratio(r["match"], ratios) > threshold)
        return F.when(F.size(runs) > 0, F.array_sort(F.concat(base, ranked(random, last)))).otherwise(base)

    both = bound(base, lambda b: F.struct(named(b).alias("base"), named(bound(runs, lambda r: added(b, r))).alias("all")))
    (found,) = free_names([*docs.columns, base_name, name], "_found")
    return docs.withColumn(found, both).withColumns({base_name: F.col(found)["base"], name: F.col(found)["all"]}).drop(found)


def _apart(base: Column, runs: Column) -> Column:
    """`runs` (start, end, match) that share no character with a span of `base` (start, rank, end).

    Both in one list by start: what comes before a run must have ended, what comes after it must not have begun.
    """
    latest = F.lit(2**31 - 1)
    item = lambda s, is_run: F.struct(s["start"].alias("start"), F.lit(is_run).alias("run"), s["end"].alias("end"), (s["match"] if is_run else F.lit(None).cast("string")).alias("match"))
    line = F.array_sort(F.concat(F.transform(base, lambda s: item(s, False)), F.transform(runs, lambda s: item(s, True))))

    def kept(line):
        ended = running(F.transform(line, lambda s: F.when(s["run"], 0).otherwise(s["end"])), F.lit(0), lambda a, b: F.greatest(a, b))
        begins = F.transform(F.reverse(line), lambda s: F.when(s["run"], latest).otherwise(s["start"]))
        begun = F.reverse(running(begins, latest, lambda a, b: F.least(a, b)))
        left = F.zip_with(line, ended, lambda s, e: F.when(s["run"] & (e <= s["start"]), s))
        return F.filter(F.zip_with(left, begun, lambda s, b: F.when(b >= s["end"], s)), lambda s: s.isNotNull())

    return F.when(F.size(base) == 0, F.transform(runs, lambda s: item(s, True))).otherwise(bound(line, kept))


def listed(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(scans: DataFrame, mark: str = "[secret]", spans: str = "spans", block: int = 4_096) -> DataFrame:
    """`scans` with each span of text replaced by `mark`; spans that overlap are replaced as one. Null text stays null.

    `spans` names the column of spans, by start. What stands between them is cut from blocks of the text, not from its beginning each time.
    """
    text, found = F.col("text"), F.col(quoted(spans))
    largest = lambda a, b: F.greatest(a, b)

    def between(ends):
        """(from, to) in front of each span that begins after all spans before it have ended, and behind the last."""
        before = F.concat(F.array(F.lit(0)), F.slice(ends, F.lit(1), F.size(ends) - 1))
        each = F.zip_with(found, before, lambda s, e: F.when(s["start"] >= e, F.struct(e.alias("from"), s["start"].alias("to"))))
        behind = F.array(F.struct(F.element_at(ends, -1).alias("from"), F.length(text).alias("to")))
        return F.concat(F.filter(each, lambda x: x.isNotNull()), behind)

    def shown(blocks, x):
        first, last = (F.floor(x[c] / block).cast("int") for c in ("from", "to"))
        return F.substring(F.array_join(F.slice(blocks, first + 1, last - first + 1), ""), x["from"] % block + 1, x["to"] - x["from"])

    parts = bound(running(F.transform(found, lambda s: s["end"]), F.lit(0), largest), between)
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    done = F.array_join(bound(blocks, lambda b: F.transform(parts, lambda x: shown(b, x))), mark)
    return scans.withColumn("text", F.when(F.size(found) > 0, done).otherwise(text))
