"""Operator 13: spelling variants by composing the vocabulary's acceptor with one edit and the acceptor again.

1. Words. Texts are cut into runs of letters, a rule of checksums deletes a letter of some, and what is long and frequent
   enough is the vocabulary. Blocks of documents count before the shuffle.
2. Partitions. Two words one edit apart, the shorter of l letters, share their first or their last l // 2 letters. Those
   letters lead the acceptor (for the last ones: of the reversed words) to a state, and what starts there is a
   partition: words of l and l + 1 letters with the same start, or end. Partitions are read as a sorted stream.
3. Composition. A partition's tails make a minimal acyclic acceptor A. The product A x (one edit) x A starts in (q, no edit,
   q): before the edit both sides are in the same state; an edit leads to a pair of states (a, edited, b) with tails in
   common, or to nothing. Pairs of states and the edits of a state are worked out once; words are known by their rank
   in the acceptor (each state counts what it accepts), so pairs are found without writing out words.
4. A partition gives each of its words the number of near words, and the most frequent one; these are summed up natively.
   Pairs found by their start are left out where they are found by their end.

A partition with more than `most` words is not read in one task: its words are dealt by the words without one letter,
which leaves at most one word a letter of the alphabet in a place, and joined natively. Nothing is dropped.

Defined results: null texts have no words, a null doc_id counts as an empty string in the checksum; an empty table gives an
empty result; rows with equal doc_id are documents of their own, their counts add up; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, by_blocks, cut, text_or_empty

#: What is no letter becomes a space, A-Z become a-z; code points above 255 are no letters and encode to a question mark.
_LETTER = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 0xC0 else 32 for x in range(256))

MOST = 50_000


def runs(text: str) -> list[bytes]:
    """The maximal runs of letters, lower-cased, one byte a code point."""
    return text.encode("latin-1", "replace").translate(_LETTER).split()


def count_runs(doc_id: str, text: str, into: dict[bytes, int], least_length: int, every: int) -> None:
    """Adds the words of a text: of a run whose checksum with the document `every` divides, one letter is deleted."""
    start = zlib.crc32(f"{doc_id}:".encode())
    for run, n in Counter(runs(text)).items():
        if len(run) < least_length:
            continue
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < least_length:
                continue
        into[run] = into.get(run, 0) + n


def vocabulary(docs: DataFrame, least_length: int = 5, least_count: int = 3, every: int = 97) -> DataFrame:
    """(word, n): the distinct results of at least `least_length` code points and `least_count` occurrences."""

    def block(rows):
        n: dict[bytes, int] = {}
        for doc_id, text in rows:
            count_runs(doc_id or "", text, n, least_length, every)
        return [(w.decode("latin-1"), k) for w, k in n.items()]

    d = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_or_empty().alias("text"))
    found = by_blocks(d, ["doc_id", "text"], "word string, n bigint", block, rows=10_000, chars=16_000_000)
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Acceptors:
    """Minimal acyclic acceptors that share their states; a word is known by its rank among those of its acceptor."""

    def __init__(self):
        self.final, self.arcs, self.count, self.longest, self.shortest = [], [], [], [], []
        self._known: dict = {}
        self._tails: dict = {}

    def accept(self, words: list[str]) -> int:
        """The first state of the minimal acceptor of sorted different words, none of which is the start of another."""
        path: list[tuple[list, bool]] = [([], False)]  # states of the last word that can still change: arcs, final
        last = ""
        for w in [*words, None]:
            same = 0
            if w is not None:
                for x, y in zip(last, w, strict=False):
                    if x != y:
                        break
                    same += 1
            while len(path) > same + 1:
                arcs, end = path.pop()
                key = (end, *arcs)
                q = self._known.get(key)
                if q is None:
                    q = self._known[key] = self._state(end, arcs)
                path[-1][0].append((last[len(path) - 1], q))
            if w is not None:
                path += [([], False) for _ in range(len(w) - same - 1)]
                path.append(([], True))
                last = w
        return self._state(False, path[0][0])

    def _state(self, end: bool, arcs: list) -> int:
        before, rows, lo, hi = int(end), {}, 0 if end else 1 << 60, 0
        for letter, q in arcs:
            rows[letter] = (q, before)
            before += self.count[q]
            lo, hi = min(lo, 1 + self.shortest[q]), max(hi, 1 + self.longest[q])
        self.final.append(end)
        self.arcs.append(rows)
        self.count.append(before)
        self.shortest.append(lo)
        self.longest.append(hi)
        return len(self.arcs) - 1

    def tails(self, a: int, b: int) -> list[tuple[int, int]]:
        """Ranks below a and b of the tails that both accept: what the composition accepts from (a, edited, b)."""
        known = self._tails
        if (a, b) in known:
            return known[a, b]
        todo = [(a, b)]
        while todo:
            x, y = pair = todo[-1]
            if x == y:
                known[pair] = [(i, i) for i in range(self.count[x])]
            elif self.longest[x] < self.shortest[y] or self.longest[y] < self.shortest[x]:
                known[pair] = []
            elif pair not in known:
                ax, ay = self.arcs[x], self.arcs[y]
                both = [(*ax[c], *ay[c]) for c in ax if c in ay]
                waits = [(p, q) for p, _, q, _ in both if (p, q) not in known]
                if waits:
                    todo += waits
                    continue
                out = [(0, 0)] if self.final[x] and self.final[y] else []
                for p, i, q, j in both:
                    out += [(i + s, j + t) for s, t in known[p, q]]
                known[pair] = out
            todo.pop()
        return known[a, b]

    def replaced(self, start: int):
        """(i, j): ranks of the pairs of words from `start` that differ in one letter, each pair once."""
        todo, seen = [(start, 0)], {}
        while todo:
            q, base = todo.pop()
            if q not in seen:
                arcs, here = list(self.arcs[q].values()), []
                for k, (a, i) in enumerate(arcs):
                    for b, j in arcs[k + 1 :]:
                        here += [(i + s, j + t) for s, t in self.tails(a, b)]
                seen[q] = here
            for i, j in seen[q]:
                yield base + i, base + j
            todo += [(a, base + before) for a, before in self.arcs[q].values() if self.count[a] > 1]

    def deleted(self, long: int, short: int):
        """(i, j): ranks of the words from `long` that become a word from `short` by deleting a letter; each pair once."""
        todo = [(long, 0, short, 0)]
        while todo:
            q, base, r, under = todo.pop()
            below = self.arcs[r]
            for c, (a, i) in self.arcs[q].items():
                # c is deleted where no c follows: of a run of one letter, the last
                if self.final[a] and self.final[r]:
                    yield base + i, under
                for d, (x, s0) in self.arcs[a].items():
                    if d != c and d in below:
                        y, t0 = below[d]
                        for s, t in self.tails(x, y):
                            yield base + i + s0 + s, under + t0 + t
                if c in below:
                    b, j = below[c]
                    todo.append((a, base + i, b, under + j))


def near_in_partition(length: int, forward: bool, part: str, tails: list[str], counts: list[int]) -> list[tuple[str, int, int, str]]:
    """(word, near words, n of the most frequent of them, that word) in one partition of sorted tails."""
    full = length - len(part)  # letters of the shorter tails
    whole = (lambda t: part + t) if forward else (lambda t: t[::-1] + part)
    short, long = ([(t, n) for t, n in zip(tails, counts, strict=True) if len(t) == k] for k in (full, full + 1))
    if not short or len(tails) < 2:
        return []
    best: dict[str, tuple] = {}

    def see(x: str, y: str, n: int) -> None:
        k, m, w = best.get(x, (0, -1, ""))
        best[x] = (k + 1, n, y) if n > m or n == m and y < w else (k + 1, m, w)

    def met(a: tuple, b: tuple) -> None:
        x, y = whole(a[0]), whole(b[0])
        if forward or x[: len(part)] != y[: len(part)]:  # else found by the start
            see(x, y, b[1])
            see(y, x, a[1])

    machine = Acceptors()
    first = machine.accept([t for t, _ in short])
    for i, j in machine.replaced(first):
        met(short[i], short[j])
    if long:
        for i, j in machine.deleted(machine.accept([t for t, _ in long]), first):
            met(long[i], short[j])
    return [(x, *found) for x, found in best.items()]


_FOUND = "word string, n_near bigint, form_n bigint, form string"


def _streamed(batches):
    """Partitions of a stream sorted by (k, tail), one at a time; k is the length, < or >, and the shared letters."""
    import pyarrow as pa

    def out(rows):
        w, k, m, f = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(k, pa.int64()), pa.array(m, pa.int64()), pa.array(f, pa.string())], names=["word", "n_near", "form_n", "form"])

    def solved(key, tails, counts):
        mark = key.find("<") if "<" in key else key.find(">")
        return near_in_partition(int(key[:mark]), key[mark] == "<", key[mark + 1 :], tails, counts)

    last, tails, counts, done = None, [], [], []
    for batch in batches:
        for k, t, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != last:
                if len(tails) > 1:
                    done += solved(last, tails, counts)
                    if len(done) > 10_000:
                        yield out(done)
                        done = []
                last, tails, counts = k, [], []
            tails.append(t)
            counts.append(n)
    if len(tails) > 1:
        done += solved(last, tails, counts)
    if done:
        yield out(done)


def dealt(words: DataFrame) -> DataFrame:
    """(k, tail, n): each word in the partitions of its length and of the length below, by its start and by its end."""
    size = F.length("word")
    row = lambda l, half: F.array(
        F.struct(F.concat(l, F.lit("<"), F.left("word", half)).alias("k"), F.substr("word", half + 1).alias("tail")),
        F.struct(F.concat(l, F.lit(">"), F.right("word", half)).alias("k"), F.reverse(F.left("word", size - half)).alias("tail")),
    )
    both = F.concat(row(size, F.floor(size / 2).cast("int")), row(size - 1, F.floor((size - 1) / 2).cast("int")))
    return words.select("n", F.explode(both).alias("p")).select("p.k", "p.tail", "n")


def near_by_letters(words: DataFrame) -> DataFrame:
    """The pairs one edit apart of words (k, word, length, n) of hot partitions, by the words without one letter.

    A form and place are shared by at most one word a letter of the alphabet; a word and what is one letter longer by at
    most that many for each place.
    """
    of = F.col("k")
    l = F.split(of, "[<>]")[0].cast("int")  # noqa: E741
    places = F.sequence(F.lit(1), F.col("length"))
    without = lambda p: F.concat(F.left("word", p - 1), F.substr("word", p + 1))
    short, long = words.where(F.col("length") == l), words.where(F.col("length") == l + 1)
    holes = short.select("k", "word", "n", F.explode(F.transform(places, lambda p: F.struct(p.alias("p"), without(p).alias("form")))).alias("h")).select("k", "word", "n", "h.p", "h.form")
    a, b = holes, holes.select("k", F.col("word").alias("other"), F.col("n").alias("other_n"), "p", "form")
    replaced = a.join(b, ["k", "p", "form"]).where(F.col("word") != F.col("other")).select("k", "word", "other", "other_n")
    cuts = long.select("k", F.col("word").alias("long"), F.col("n").alias("long_n"), F.explode(F.array_distinct(F.transform(places, without))).alias("word"))
    met = cuts.join(short.select("k", "word", "n"), ["k", "word"])
    deleted = met.select("k", "word", F.col("long").alias("other"), F.col("long_n").alias("other_n"))
    back = met.select("k", F.col("long").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    half = F.floor(l / 2).cast("int")
    found = replaced.unionByName(deleted).unionByName(back)
    twice = of.contains(">") & (F.left("word", half) == F.left("other", half))  # found by the start
    return found.where(~twice).select("word", F.lit(1).cast("bigint").alias("n_near"), F.col("other_n").alias("form_n"), F.col("other").alias("form"))


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, n_near, form_n, form): for each of (word, n) that has near words, their number and the most frequent one."""
    rows = dealt(words)
    hot = cut(rows.groupBy("k").count().where(F.col("count") > most).select("k"))
    if hot.isEmpty():
        found = rows.repartition("k").sortWithinPartitions("k", "tail").select("k", "tail", "n").mapInArrow(_streamed, _FOUND)
    else:
        marked = attach(rows, hot.withColumn("_hot", F.lit(True)), ["k"], how="left")
        cold = marked.where(F.col("_hot").isNull()).select("k", "tail", "n")
        found = cold.repartition("k").sortWithinPartitions("k", "tail").mapInArrow(_streamed, _FOUND)
        part = F.split("k", "[<>]")[1]
        word = F.when(F.col("k").contains("<"), F.concat(part, "tail")).otherwise(F.concat(F.reverse("tail"), part))
        rest = marked.where(F.col("_hot")).select("k", word.alias("word"), "n").withColumn("length", F.length("word"))
        found = found.unionByName(near_by_letters(rest))
    first = F.min(F.struct((-F.col("form_n")).alias("m"), F.col("form").alias("form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("_f")).select("word", "n_near", (-F.col("_f.m")).alias("form_n"), F.col("_f.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): forms are followed to the last, twice as far in each round.

    A form's n is at least twice its word's, so chains have no circles and are no longer than the logarithm of the
    largest n.
    """
    at = cut(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")))
    while not at.where("open").isEmpty():
        further = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = attach(at, further, ["root"], how="left")
        at = cut(step.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("open")))
    return at.select("word", "root")


def variants(docs: DataFrame, least_length: int = 5, least_count: int = 3, every: int = 97, times: int = 2, most: int = MOST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the vocabulary of `docs` (doc_id, text)."""
    words = cut(vocabulary(docs, least_length, least_count, every))
    near = near_words(words, most)
    known = F.col("form_n") >= times * F.col("n")
    joined = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(known, F.col("form")).alias("form"), F.when(known, F.col("form_n")).alias("form_n"))
    joined = cut(joined)
    named = joined.join(roots(joined.where("form IS NOT NULL")), "word", "left")
    return named.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
