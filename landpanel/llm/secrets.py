"""Operator 5: secret scans by patterns and by character Markov models, in DataFrame operations alone.

Three patterns give the base spans. The method adds spans of its own: every token of 12 or more key-like characters that
touches no base span is scored by the mean log-likelihood ratio of its character pairs under two first-order models, one
of random strings and one of ordinary identifiers; those above a threshold become spans of kind `markov`.

A token's mix says whether it has small letters, capitals and digits. Each mix has models of its own, so letters alone are
held against words and constants in capitals against capitals, and each mix and class of length (under 16, under 24, more)
has a threshold of its own, since the mean of few pairs scatters more. A mix that no random sample shows, such as digits
with hyphens, is never flagged.

Both models are trained from labelled samples. Random strings are the values of all base spans of the corpus, and for
each of seven usual alphabets (base64, base64 in one case, letters and digits in one or both cases, letters of one case)
`drawn` strings cut from digests of the numbers from 0. Ordinary identifiers are the words of 4 to 11 key-like
characters, too short to be scored themselves, outside base spans and without a mixture of letters and digits, of a
bounded sample of documents (`ordinary_docs`, those first in a fixed scattering of doc_id), and the words of WORDS, alone and joined in threes as
identifiers are (camelCase, snake_case, capitals, hyphens, slashes, with a number, with a date). Kinds of samples have
the same weight. A model mixes character pairs with pairs of character classes, each class uniform inside. Of both samples
a part is held out; a threshold stands between the means of the held-out identifiers, of which one in two thousand may
lie above it, and those of the held-out random strings. Only pair counts, at most 7 x 17 x 68 x 68 numbers, and the
thresholds reach the driver.

Spark's regular expressions find the matches, in two to four walks over a text for each pattern that occurs in it; their
places are running sums of the gaps between them, over the matches of one text.

Defined results: null text is the empty text and has no spans; equal texts get equal spans; a corpus without base spans
trains the random model from the drawn strings alone; one without words trains the other from its priors; repeated rows
are scanned each; an empty table gives an empty result; other columns are not read. Spans count code points, with the
end exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, cut, text_or_empty
from .mixing import order_key

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A maximal run that is too short holds no longer one, so the least length may stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9+/_=-]{12,}"
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
#: Ordinary words of programs and files, in any order: samples that do not depend on the language of the corpus.
WORDS = """
abort account action active address admin agent alert align allow amount analysis angle append apply archive argument array assign async attempt author available average
backup balance base batch before begin binary block border branch bridge browser buffer build button bytes cache calendar call cancel catalog category center change channel
check child circle class clean client clock close cluster code collect color column command comment commit common compare compile complete compute config connect content
context control convert copy core count create current custom data database date debug default define delete deploy depth detail device digest direct disable display
document domain download draft driver dynamic editor element email enable encode engine entry error event exact example exception execute export extend extract factory
failure feature fetch field filter final find finish first flag flush folder follow footer force format frame from function future gateway general generate global graph
group handler hash header height helper hidden history host image import include index initial input insert instance integer internal invalid issue item iterator join
kernel language last layer layout leader length level library limit line link list listen load local lock logger login lookup machine main manager mapping master match
maximum member memory menu merge message method metric middle minimum missing model module monitor month mount move multiple name native network next node normal notice
number object offset online open operator option order origin output owner package page panel parent parse partition password path pattern payment pending person phone
pixel place player plugin point policy pool port position prefix prepare present previous primary print private process product profile program project property protocol
provider public publish query queue quick random range rating reader ready receive record recover reduce refresh region register release remote remove render repeat
replace report request require reset resize resolve resource response restart result resume retry return review right role root rotate route rule running sample save
scale schedule schema scope score script scroll search second section secure select sender separate sequence server service session setting setup shadow shape share shift
short signal simple single size snapshot socket sort source space special split stack stage standard start state static status step stop storage store stream string style
submit subject success suffix summary support switch symbol sync system table target task team template temporary test text theme thread threshold ticket time timeout title
toggle token total trace track traffic transaction transfer transform trigger type unique unit update upload user valid value variable vector verify version video view
virtual visible wait warning watch weight widget width window word worker workspace wrapper write year zone
"""
MATCH = "array<struct<kind: int, k: int, gap: int, size: int, value: string>>"
SPAN = "array<struct<start: int, kind: int, end: int>>"


def matches(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as (kind, number, gap before it, size, value of the group)."""
    p = F.lit(pattern)
    found = F.regexp_extract_all(text, p, F.lit(0))
    values = F.regexp_extract_all(text, p, F.lit(group)) if group else found
    both = F.zip_with(F.zip_with(F.split(text, pattern, -1), found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"))), values, lambda x, v: F.struct(x["gap"], x["size"], v.alias("value")))
    both = F.transform(F.filter(both, lambda x: x["size"].isNotNull()), lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("k"), x["gap"], x["size"], x["value"]))
    return F.when(F.regexp(text, p), both.cast(MATCH)).otherwise(F.array().cast(MATCH))


def pairs(value: Column) -> Column:
    """The pairs of neighbouring characters, in one walk along the text."""
    c = F.split(value, "")
    c = F.filter(c, lambda x: x != "")
    return F.filter(F.zip_with(c, F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))), lambda a, b: F.concat(a, b)), lambda x: x.isNotNull())


def ratios(counts: list, mix: float = 0.5) -> list[tuple[str, float]]:
    """(pair, log-likelihood ratio) of random over ordinary for all pairs of the alphabet, from (label, pair, weight)."""

    def kind(c: str) -> str:
        return "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "-"

    width = {k: sum(kind(c) == k for c in ALPHABET) for k in "aA0-"}
    models = []
    for label in (1, 0):
        n: dict = {}
        for which, p, c in counts:
            if which == label and len(p) == 2 and p[0] in ALPHABET and p[1] in ALPHABET:
                n[p] = n.get(p, 0) + c
        rows, classes = {}, {}
        for p, c in n.items():
            rows[p[0]] = rows.get(p[0], 0) + c
            classes[kind(p[0]), kind(p[1])] = classes.get((kind(p[0]), kind(p[1])), 0) + c
        each = {a: sum(classes.get((a, b), 0) + 1 for b in "aA0-") for a in "aA0-"}

        def likely(a, b, n=n, rows=rows, classes=classes, each=each):
            by_class = (classes.get((kind(a), kind(b)), 0) + 1) / each[kind(a)] / width[kind(b)]
            own = (n.get(a + b, 0) + 4 * by_class) / (rows.get(a, 0) + 4)
            return mix * own + (1 - mix) * by_class

        models.append(likely)
    return [(a + b, math.log(models[0](a, b) / models[1](a, b))) for a in ALPHABET for b in ALPHABET]


def mix(value: Column) -> Column:
    """1 for small letters, 2 for capitals, 4 for digits, added up."""
    return sum((F.regexp(value, F.lit(f"[{k}]")).cast("int") * n for k, n in (("a-z", 1), ("A-Z", 2), ("0-9", 4))), F.lit(0))


def length_class(value: Column) -> Column:
    return F.when(F.length(value) < 16, 0).when(F.length(value) < 24, 1).otherwise(2)


def drawn(spark, n: int) -> DataFrame:
    """(sample, value): n random strings of 12 to 40 characters for each alphabet, cut from digests of numbers."""
    raw = F.base64(F.unhex(F.sha2(F.concat(F.lit("drawn "), F.col("id").cast("string")), 256)))
    plain = F.regexp_replace(raw, "[+/=]", "")
    kinds = {"base64": raw, "url": F.translate(raw, "+/=", "-_"), "mixed": plain, "upper": F.upper(plain), "lower": F.lower(plain)}
    kinds |= {"letters": F.regexp_replace(F.lower(plain), "[0-9]", ""), "capitals": F.regexp_replace(F.upper(plain), "[0-9]", ""), "both": F.regexp_replace(plain, "[0-9]", "")}
    d = spark.range(n).select("id", F.explode(F.array(*(F.struct(F.lit(k).alias("sample"), v.alias("value")) for k, v in kinds.items()))).alias("x"))
    return d.select("x.sample", F.substring("x.value", F.lit(1), (F.lit(12) + F.col("id") % 29).cast("int")).alias("value"))


def joined(words: DataFrame) -> DataFrame:
    """(sample, value): identifiers made of three words (a, b, c) of a row, in the usual ways."""
    a, b, c = (F.coalesce(F.col(k), F.lit("")) for k in "abc")
    cap = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x)))
    with_ = lambda sep, *x: F.concat_ws(sep, *(F.when(k != "", k) for k in x))
    number = F.pmod(F.xxhash64(a, b), F.lit(100)).cast("string")
    day = F.date_add(F.lit("1990-01-01").cast("date"), F.pmod(F.xxhash64(a, b, c), F.lit(20_000)).cast("int"))
    stamp, clock = F.date_format(day, "yyyyMMdd"), F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"), F.date_format(F.timestamp_seconds(F.pmod(F.xxhash64(c, a), F.lit(86_400))), "HH-mm-ss"), F.lit("Z"))
    snake = with_("_", a, b, c)
    whole = {
        "words": (a, b, c), "camel": (F.concat(a, cap(b), cap(c)), F.concat(cap(a), cap(b), cap(c))), "joined": (snake, with_("-", a, b, c), with_("/", a, b, c)),
        "capitals": (F.upper(snake), F.upper(with_("-", a, b, c)), F.upper(F.concat(a, b, c))), "run on": (F.concat(a, b, c), F.concat(a, b)),
        "numbered": (F.concat(snake, number), F.concat_ws("_", a, number, b), F.concat(F.upper(snake), F.lit("_"), number), F.concat(a, cap(b), cap(c), number), F.concat_ws("-", a, F.concat(F.lit("v"), number), b)),
        "marked": (F.concat_ws("-", F.upper(a), F.concat(F.lit("v"), number), F.upper(b)), F.concat(F.upper(a), F.lit("_"), b, number), F.concat(a, number, F.upper(b)), F.concat(F.upper(a), F.lit("x"), number, F.upper(b))),
        "dated": (with_("-", stamp, a, b), with_("_", a, stamp), F.concat_ws("-", clock, b), F.concat_ws("/", a, F.date_format(day, "yyyy/MM/dd"), b), F.concat(cap(a), cap(b), stamp), F.upper(with_("_", a, b, stamp))),
    }
    return words.select(F.explode(F.array(*(F.struct(F.lit(k).alias("sample"), F.array(*v).alias("v")) for k, v in whole.items()))).alias("x")).select("x.sample", F.explode("x.v").alias("value"))


def ordinary(docs: DataFrame, text: Column, n: int) -> DataFrame:
    """(sample, value): words of the first `n` documents and of WORDS, and identifiers made of them."""
    first = docs.select(order_key().alias("o"), "doc_id").orderBy("o", "doc_id").limit(n).select("doc_id").distinct()
    some = attach(docs, first, ["doc_id"], how="left_semi").select(F.regexp_replace(text, f"{ASSIGN}|{ACCESS}|{HEX}", " ").alias("text"))
    # a maximal run of key-like characters that is all letters or holds none; what may be a secret is no sample
    word = F.regexp_extract_all("text", F.lit("(?<![A-Za-z0-9+/_=-])(?:[A-Za-z+/_=-]{4,11}|[0-9+/_=-]{4,11})(?![A-Za-z0-9+/_=-])"), F.lit(0))
    after = [F.slice(word, F.lit(k), F.lit(1 << 30)) for k in (2, 3)]
    threes = some.select(F.posexplode(F.arrays_zip(word.alias("a"), *(x.alias(n) for x, n in zip(after, "bc", strict=True)))).alias("i", "x")).where(F.col("i") % 3 == 0).select("x.*")
    words = WORDS.split()
    at = lambda k, step: F.get(F.array(*map(F.lit, words)), F.pmod(F.col("id") * step + k, F.lit(len(words))).cast("int"))
    own = docs.sparkSession.range(4 * len(words)).select(at(0, 1).alias("a"), at(1, 7).alias("b"), at(2, 13).alias("c"))
    corpus, fixed = joined(threes), joined(own).withColumn("sample", F.concat(F.lit("fixed "), "sample"))
    return corpus.unionByName(fixed)


def fit(samples: DataFrame) -> tuple[list[tuple[int, str, float]], list[tuple[int, int, float]]]:
    """(mix, pair, ratio) and (mix, length class, threshold on the mean), from labelled samples (label, sample, value).

    One value in five, by its hash, is held out for the thresholds. Kinds of samples weigh the same within a label and mix.
    """
    s = cut(samples.withColumns({"held": F.pmod(F.xxhash64("value"), F.lit(5)) == 0, "mix": mix(F.col("value"))}))
    known = F.col("pair").rlike("^[A-Za-z0-9+/_=.-]{2}$")
    counts = s.where(~F.col("held")).select("label", "sample", "mix", F.explode(pairs(F.col("value"))).alias("pair")).where(known).groupBy("label", "sample", "mix", "pair").agg(F.count("*").alias("n")).collect()
    total: dict = {}
    for r in counts:
        total[r.label, r["sample"], r.mix] = total.get((r.label, r["sample"], r.mix), 0) + r.n
    llr = []
    for m in sorted({r.mix for r in counts}):
        llr += [(m, p, x) for p, x in ratios([(r.label, r.pair, 10_000 * r.n / total[r.label, r["sample"], m]) for r in counts if r.mix == m])]
    held = s.where(F.col("held") & (F.length("value") >= 12)).select(F.monotonically_increasing_id().alias("row"), "label", "value")
    means = scored(cut(held), llr, "row", "label").groupBy("label", "mix", "size").agg(F.expr("percentile(score, array(0.02D, 0.9995D))").alias("p")).collect()
    p = {(r.label, r.mix, r["size"]): r.p for r in means}
    limits = []
    for (label, m, size), (low, _) in p.items():
        if label == 1:
            high = p[0, m, size][1] if (0, m, size) in p else 0.0  # between nearly all identifiers and nearly all random strings
            limits.append((m, size, max(high, (high + low) / 2)))
    return llr, limits


def scored(values: DataFrame, llr: list[tuple[int, str, float]], *keys: str) -> DataFrame:
    """(keys, mix, size, score): the mean ratio of the pairs of each value, its mix and its class of length."""
    table = values.sparkSession.createDataFrame(llr, "mix int, pair string, llr double")
    one = values.select(*keys, mix(F.col("value")).alias("mix"), length_class(F.col("value")).alias("size"), F.explode(pairs(F.col("value"))).alias("pair")).join(F.broadcast(table), ["mix", "pair"])  # 7 x 68 x 68 rows
    return one.groupBy(*keys, "mix", "size").agg((F.sum(F.round("llr", 9)) / F.count("*")).alias("score"))


def scan(docs: DataFrame, threshold: float | None = None, ordinary_docs: int = 400, random_strings: int = 500, text_col: str = "text") -> DataFrame:
    """doc_id, and the base spans and all spans of its text as arrays of (start, kind, end), sorted.

    The thresholds on the mean ratio are taken from held-out samples unless one is given for all.
    """
    text = text_or_empty(text_col)
    found = F.concat(matches(text, ASSIGN, 0, 2), matches(text, ACCESS, 1), matches(text, HEX, 2), matches(text, TOKEN, 3))
    rows = cut(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", found.alias("found")))
    each = rows.select("row", F.explode("found").alias("m")).select("row", "m.*")
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("row", "kind").orderBy("k"))
    each = each.withColumn("end", end.cast("int")).withColumn("start", (F.col("end") - F.col("size")).cast("int"))
    each = each.where((F.col("kind") > 0) | (F.length("value") >= 12))
    # a token touches a base span if one that began before it ends inside it, or the next one begins inside it
    base, along = F.col("kind") < 3, Window.partitionBy("row").orderBy("start", "kind", "end")
    back = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind"), F.desc("end"))  # frames that only grow take linear time
    before = F.max(F.when(base, F.col("end"))).over(along.rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(base, F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, -1))
    each = each.withColumns({"before": before, "after": after})
    free = (F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.coalesce(F.col("after") >= F.col("end"), F.lit(True)))
    each = cut(each.where(base | free).select("row", "start", "kind", "end", "value"))

    random = each.where(base).select(F.get(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("sample"), "value").unionByName(drawn(docs.sparkSession, random_strings))
    samples = random.withColumn("label", F.lit(1)).unionByName(ordinary(docs, text, ordinary_docs).withColumn("label", F.lit(0)))
    llr, limits = fit(samples)
    if threshold is not None:
        limits = [(m, size, threshold) for m in range(8) for size in range(3)]
    least = docs.sparkSession.createDataFrame(limits, "mix int, size int, least double")
    markov = scored(each.where(~base), llr, "row", "start", "end").join(F.broadcast(least), ["mix", "size"]).where(F.col("score") > F.col("least"))  # 24 rows
    spans = each.where(base).select("row", "start", "kind", "end").unionByName(markov.select("row", "start", F.lit(3).alias("kind"), "end"))
    spans = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).cast(SPAN).alias("spans"))
    out = attach(rows.select("row", "doc_id"), cut(spans), ["row"], how="left").withColumn("spans", F.coalesce("spans", F.array().cast(SPAN)))
    return out.select("doc_id", F.filter("spans", lambda s: s["kind"] < 3).alias("base"), "spans")


def written(column: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
