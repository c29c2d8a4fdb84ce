"""Spelling variants: words one edit apart, by a positional q-gram inverted index with a count filter.

A word is read by every task that it may have a partner in.  One edit leaves the first or the last half of the shorter
word as it is, so words are dealt by either half (and the shorter one's length).  A group of more than ``most`` words
is dealt again by halves of what its words don't share, until it is small or its words differ in one place alone (then
the alphabet bounds it); so no group grows with the table, and none is cut short.

Inside a task the groups' q-grams, with their positions, make one inverted index.  Each word's posting lists - those of its
own length at the same position, those of the next shorter length at the same or the position before - are merged in
order of word numbers, which counts common grams.  One edit spoils at most q grams of the longer word: pairs with fewer
than all but q in common are dropped, the others verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, mix64, scratch, table

_MOST_GRAMS = 16  # grams that a long word is probed with; the bound counts these
_PAIRS = 1 << 20  # places of merged postings held at once
_OUT = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _steps(c: int, path: str) -> tuple[int, int, list[tuple[int, int]]]:
    """(shared prefix, shared suffix, places that must differ): what a group's path says of its words."""
    lo = hi = 0
    unlike = []
    for step in path:
        half = (c - lo - hi) // 2
        if step == "P":
            lo += half
        else:  # a pair that shares the first half too is found in the other group
            unlike.append((lo, lo + half))
            hi += half
    return lo, hi, unlike


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] of them, for all i in turn."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


class _Batch:
    """Whole groups of words: their codes, group numbers and index."""

    def __init__(self, words: list[str], n: np.ndarray, groups: np.ndarray, c: np.ndarray, paths: list[str]):
        self.words, self.n, self.group = words, n, groups
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        self.codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        self.start = np.cumsum(self.length) - self.length
        self.c = c
        known = {k: _steps(*k) for k in set(zip(c.tolist(), paths, strict=True))}
        steps = [known[k] for k in zip(c.tolist(), paths, strict=True)]
        self.lo = np.array([s[0] for s in steps], np.int64)
        self.hi = np.array([s[1] for s in steps], np.int64)
        deep = max(len(s[2]) for s in steps)
        self.unlike = np.array([s[2] + [(0, 0)] * (deep - len(s[2])) for s in steps], np.int64).reshape(len(steps), deep, 2)
        self.q = np.where(c - self.lo - self.hi >= 3, 2, 1)

    def grams(self, which: np.ndarray, most: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, place, gram) of the grams that reach out of what a group shares; ``most``: evenly spread ones a word."""
        q = self.q[which]
        first = np.maximum(self.lo[which] - q + 1, 0)
        number = np.minimum(self.length[which] - self.hi[which], self.length[which] - q + 1) - first
        taken = number if most is None else np.minimum(number, most)
        at = _spread(np.zeros(len(which), np.int64), taken)
        word = np.repeat(which, taken)
        place = np.repeat(first, taken) + at * np.repeat(number, taken) // np.repeat(np.maximum(taken, 1), taken)
        where = self.start[word] + place
        gram = self.codes[where]
        two = self.q[word] == 2
        gram[two] = (gram[two] << np.uint64(21)) | self.codes[where[two] + 1]
        return word, place, gram

    def keys(self, word: np.ndarray, place: np.ndarray, gram: np.ndarray) -> np.ndarray:
        return mix64(mix64(gram + np.uint64(1)) + mix64((self.group[word].astype(np.uint64) << np.uint64(24)) + place.astype(np.uint64)))

    def near(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (a, b) one edit apart, each once."""
        short = np.flatnonzero(self.length == self.c)
        long = np.flatnonzero(self.length == self.c + 1)
        found = []
        # Words of one length: the same gram at the same place.  Where one place is left, all of a group are candidates.
        word, place, gram = self.grams(short, _MOST_GRAMS)
        grams = np.bincount(word, minlength=len(self.words))
        bare = short[self.c[short] - self.lo[short] - self.hi[short] == 1]
        post_word = np.concatenate([word, bare])
        post_key = np.concatenate([self.keys(word, place, gram), mix64(self.group[bare].astype(np.uint64) + np.uint64(1 << 60))])
        bound = grams - self.q
        bound[bare] += 1
        found.append(self.merged(post_word, post_key, post_word, post_key, bound, True))
        # A longer word's gram lies where the shorter one has it, or one place behind.
        word, place, gram = self.grams(long, _MOST_GRAMS)
        bound = np.bincount(word, minlength=len(self.words)) - self.q
        probe_word = np.concatenate([word, word])
        probe_key = np.concatenate([self.keys(word, place, gram), self.keys(word, place - 1, gram)])
        word, place, gram = self.grams(short, None)
        found.append(self.merged(probe_word, probe_key, word, self.keys(word, place, gram), bound, False))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def merged(self, probe_word, probe_key, post_word, post_key, bound, later: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (probe, posted) whose lists meet ``bound`` times, verified; ``later``: only words behind the probe."""
        order = np.lexsort((post_word, post_key))
        post_word, post_key = post_word[order], post_key[order]
        order = np.argsort(probe_word, kind="stable")
        probe_word, probe_key = probe_word[order], probe_key[order]
        begin = np.searchsorted(post_key, probe_key)
        end = np.searchsorted(post_key, probe_key, "right")
        sizes = np.cumsum(end - begin)
        out_a, out_b = [], []
        i = 0
        while i < len(probe_word):
            # as many probes as fit, all grams of a word together
            k = int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + _PAIRS, "right"))
            k = len(probe_word) if k >= len(probe_word) else int(np.searchsorted(probe_word, probe_word[k]))
            k = k if k > i else int(np.searchsorted(probe_word, probe_word[i], "right"))
            a = np.repeat(probe_word[i:k], (end - begin)[i:k])
            b = post_word[_spread(begin[i:k], (end - begin)[i:k])]
            if later:
                a, b = a[b > a], b[b > a]
            pair = np.sort(a * len(self.words) + b, kind="stable")  # sorted runs merge
            first = np.flatnonzero(np.diff(pair, prepend=-1))
            times = np.diff(np.append(first, len(pair)))
            a, b = np.divmod(pair[first], len(self.words))
            kept = times >= bound[a]
            a, b = self.verified(a[kept], b[kept])
            out_a.append(a)
            out_b.append(b)
            i = k
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])

    def verified(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those with just one edit that no other group has."""
        ok = self.group[a] == self.group[b]
        a, b = a[ok], b[ok]
        ok = np.zeros(len(a), bool)
        step = max(1, (1 << 21) // int(self.length[a].max())) if len(a) else 1
        for i in range(0, len(a), step):
            x, y = a[i : i + step], b[i : i + step]
            width = int(self.length[x].max()) + 1
            at = np.arange(width)
            left, right = (np.where(at < self.length[w, None], self.codes[np.minimum(self.start[w, None] + at, len(self.codes) - 1)], 0) for w in (x, y))
            same = left == right
            one = same.sum(1) == width - 1
            moved = np.ones_like(same)
            moved[:, :-1] = left[:, 1:] == right[:, :-1]
            gap = (moved | (at < np.argmin(same, 1)[:, None])).all(1)
            fine = np.where(self.length[x] == self.length[y], one, gap)
            for j in range(self.unlike.shape[1]):
                lo, hi = self.unlike[x, j, 0][:, None], self.unlike[x, j, 1][:, None]
                fine &= (hi[:, 0] == lo[:, 0]) | ~(same | (at < lo) | (at >= hi)).all(1)
            ok[i : i + step] = fine
        return a[ok], b[ok]

    def answers(self) -> pa.RecordBatch:
        """(word, near partners, the most frequent partner) of the words that have any."""
        a, b = self.near()
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
        rank = np.empty(len(self.words), np.int64)
        rank[sorted(range(len(self.words)), key=self.words.__getitem__)] = np.arange(len(self.words))
        order = np.lexsort((rank[b], -self.n[b], a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.diff(a, prepend=-1))
        counts = np.diff(np.append(first, len(a)))
        best = b[first]
        return pa.RecordBatch.from_arrays([pa.array([self.words[i] for i in a[first]], pa.string()), pa.array(counts, pa.int64()), pa.array(self.n[best], pa.int64()), pa.array([self.words[i] for i in best], pa.string())], schema=_OUT)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group; whole groups are searched together, about 20,000 words at once."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def batch_of(t: pa.Table) -> pa.RecordBatch:
        key = t["key"].to_numpy()
        groups = np.cumsum(np.diff(key, prepend=key[:1]) != 0)
        return _Batch(t["word"].to_pylist(), t["n"].to_numpy(), groups, t["c"].to_numpy().astype(np.int64), t["path"].to_pylist()).answers()

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < 20_000 and sum(b.nbytes for b in held) < 8 << 20:
            continue
        t = pa.Table.from_batches(held)
        key = t["key"].to_numpy()
        whole = int(np.flatnonzero(key != key[-1])[-1] + 1) if (key != key[-1]).any() else 0
        if whole:
            yield batch_of(t.slice(0, whole))
            held, rows = t.slice(whole).combine_chunks().to_batches(), t.num_rows - whole
    if rows:
        yield batch_of(pa.Table.from_batches(held))


def _halves(rows: DataFrame) -> DataFrame:
    """Every word in the group of its first half and in that of its last half, of what its group doesn't share yet."""
    half = F.floor((F.col("c") - F.col("lo") - F.col("hi")) / 2).cast("int")
    step = lambda p, lo, hi: F.struct(F.concat("path", F.lit(p)).alias("path"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    rows = rows.select("word", "n", "c", F.explode(F.array(step("P", F.col("lo") + half, F.col("hi")), step("S", F.col("lo"), F.col("hi") + half))).alias("g"))
    return rows.select(F.xxhash64("c", "g.path", F.left("word", F.col("g.lo")), F.right("word", F.col("g.hi"))).alias("key"), "word", "n", "c", "g.path", "g.lo", "g.hi")


def near_words(words: DataFrame, *, least: int = 7, most: int = 512) -> DataFrame:
    """(word, near, best_n, best): of each word that has one, how many others are one edit away, and the one with the largest
    ``n`` (ties: the first in code-point order).

    ``words`` (word, n) are distinct and have ``least`` (4 at least) code points or more.  ``most``: words of a
    group before it is dealt again.
    """
    if least < 4:
        raise ValueError("words of fewer than 4 code points have no halves to be found by")
    length = F.char_length("word")
    rows = words.where(length >= least).select("word", "n", F.explode(F.array(length, length - 1)).alias("c")).where(F.col("c") >= least)
    rows, parts = rows.select("word", "n", "c", F.lit("").alias("path"), F.lit(0).alias("lo"), F.lit(0).alias("hi")), []
    while True:
        dealt = _halves(rows)
        large = dealt.groupBy("key").count().where(F.col("count") > most).select(F.col("key").alias("large"))
        dealt = cut(dealt.join(large, F.col("key") == F.col("large"), "left").withColumn("again", F.col("large").isNotNull() & (F.col("c") - F.col("lo") - F.col("hi") > 1)).drop("large"), "dealt")
        parts.append(dealt.where("not again"))
        rows = dealt.where("again").select("word", "n", "c", "path", "lo", "hi")
        if rows.isEmpty():
            break
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    tasks = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), whole.count() // 200_000)
    found = whole.select("key", "word", "n", "c", "path").repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(_search, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("near").alias("near"), best.alias("b")).select("word", "near", (-F.col("b.n")).alias("best_n"), F.col("b.w").alias("best"))


def spelling_forms(words: DataFrame, *, least: int = 7, times: int = 10, most: int = 512) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct ``words`` (word, n).

    form: the most frequent near word (ties: the first in code-point order) if it has ``times`` the word's ``n``, else null; root: where
    the forms lead.  ``n`` grows ``times`` with every form, so chains are short and pointers doubled a few times reach
    their ends.  Words of fewer than ``least`` code points have no partners; an empty table gives an empty one.
    """
    words = cut(words.select("word", F.col("n").cast("long").alias("n")), "words")
    found = near_words(words, least=least, most=most).withColumnRenamed("word", "w")
    rows = words.join(found, F.col("word") == F.col("w"), "left")
    has = F.col("best_n") >= times * F.col("n")
    rows = cut(rows.select("word", "n", F.coalesce("near", F.lit(0)).alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")), "forms")
    to = rows.where("form is not null").select("word", F.col("form").alias("root"))
    top, longest = rows.agg(F.max("form_n")).first()[0] or 0, 0
    while top >= times:  # a chain's last n is at least times ** its length
        top, longest = top // times, longest + 1
    reach = 1
    while reach < longest:
        on = to.select(F.col("word").alias("w"), F.col("root").alias("further"))
        to = cut(to.join(on, F.col("root") == F.col("w"), "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
        reach *= 2
    to = to.withColumnRenamed("word", "w")
    return rows.join(to, F.col("word") == F.col("w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _without(run: Column, at: Column) -> Column:
    return F.concat(F.left(run, at), F.substring(run, at + 2, F.char_length(run)))


def words_of_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 7, damage: int | None = None) -> DataFrame:
    """(word, n): runs of Latin letters, A-Z lower-cased, and how often they are there; null texts have none.

    ``damage``: where it divides the crc32 of ``<id>:<run>``, the run loses a letter (a null id counts as empty).
    """
    text = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(rf"[a-zÀ-ÿ]{{{least},}}"), F.lit(0))).alias("run"))
    word = F.col("run")
    if damage:
        h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        word = F.when(h % damage == 0, _without(word, (h % F.char_length("run")).cast("int"))).otherwise(word)
    return runs.select(word.alias("word")).where(F.char_length("word") >= least).groupBy("word").agg(F.count("*").alias("n"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of 7 letters or more that is there twice, the word it is a variant of, and the root of the chain."""
    with scratch(spark) as keep:
        words = words_of_texts(table(spark, sf_dir, "documents"), damage=31).where("n >= 2")
        out = cut(spelling_forms(words), "spelling")
        keep.append(out)
    return out.select("word", "form", "root", "n", "n_near", "form_n")
