"""Language-model scores from Brown class-based n-grams.

Every training word has a class. Exchange clustering moves the most frequent words, whose bigrams fit on the driver,
between classes as long as the class bigrams say more about each other. All other words then make the same exchange
against those classes, spread over the cluster: the classes of a word's neighbours, counted over the whole corpus,
say in which class it raises the likelihood most. A word's probability is that of its class after the class before
it, times that of the word in its class. The number of classes grows with the vocabulary; no word is left out.

Null and wordless texts are one end token. A text of any length is one row; its words are counted before anything is
shuffled. Equal rows are scored alike and all returned. An empty table has no scores; without training rows the
probabilities are uniform. Columns other than id and text are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspan.llm.textops import coded, pieces, segment_sums, split_words
from foldspan.plans.lineage import cut

#: Most frequent words, which the driver clusters, and rounds of that clustering.
CORE, SWEEPS = 1500, 5
#: A vocabulary of V words has V ** CLASS_POWER classes; two of 256 class numbers are for the other words and the end.
CLASS_POWER, MOST_CLASSES = 0.3, 254
#: Words whose counts and classes go to every task; those of rarer ones are looked up by a join.
FREQUENT = 200_000
#: Add-constants of words in a class and of class bigrams, and the weight of the classes' own frequencies.
WORD_ADD, BIGRAM_ADD, UNIGRAM_SHARE = 0.5, 0.1, 0.02
#: Bits of a packed event that hold the neighbour's class and side; the others hold its number.
SIDE_BITS = 9
#: The largest number in one entry of a document's class pairs.
MOST_TIMES = (1 << 16) - 1


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, most=12 << 20):
        _, flat = split_words(batch.column("text"), lower=True)
        codes, words = coded(flat)
        yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(np.bincount(codes, minlength=len(words)), pa.int64())], names=["word", "n"])


class Vocabulary:
    """Types of words: the core words, then all other words as one, then the end of a text (also what is before it)."""

    def __init__(self, core: list[str]):
        self.core = core
        self.other, self.end, self.types = len(core), len(core) + 1, len(core) + 2
        self.keys = pa.array(core, pa.large_string())

    def of(self, words: pa.Array) -> np.ndarray:
        return found(words, self.keys, self.other)

    def sequence(self, types: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All types with an end after each text, and the type before each of them."""
        after = np.insert(types, bounds[1:], self.end)
        return after, np.concatenate([[self.end], after[:-1]])


def found(words: pa.Array, keys: pa.Array, otherwise: int) -> np.ndarray:
    """The place of each word among the keys."""
    if not len(words):
        return np.zeros(0, np.int64)
    return pc.fill_null(pc.index_in(words, value_set=keys), otherwise).to_numpy(zero_copy_only=False).astype(np.int64)


def _bigrams(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    v = shared.value
    total = np.zeros(v.types * v.types, np.int64)
    for batch in pieces(batches):
        bounds, flat = split_words(batch.column("text"), lower=True)
        codes, words = coded(flat)
        after, before = v.sequence(v.of(words)[codes], bounds)
        np.add.at(total, before * v.types + after, 1)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], names=["pair", "n"])


def exchange_classes(bigrams: np.ndarray, classes: int, sweeps: int = SWEEPS, fixed: int = 2) -> np.ndarray:
    """The class of each type: types move, most frequent first, to the class that raises the likelihood most.

    ``bigrams`` counts types (row) before types (column). The last ``fixed`` types keep a class to themselves, the
    last classes. Ends when no type moves or after ``sweeps`` rounds.
    """
    n = len(bigrams)
    free = n - fixed
    open_ = max(1, min(classes, free))
    k = open_ + fixed
    size = bigrams.sum(axis=0)
    order = np.argsort(-size[:free], kind="stable")
    cls = np.zeros(n, np.int64)
    cls[order] = np.arange(free) % open_
    cls[free:] = np.arange(open_, k)
    xlogx = lambda x: x * np.log(np.maximum(x, 1e-300))
    b = bigrams.astype(np.float64)
    member = np.zeros((n, k))
    member[np.arange(n), cls] = 1
    joint = member.T @ b @ member
    ahead, behind = b @ member, b.T @ member  # counts of each type before and after each class
    for _ in range(sweeps):
        moved = 0
        for t in order:
            old, own, right, left = cls[t], b[t, t], ahead[t].copy(), behind[t].copy()
            right[old] -= own
            left[old] -= own
            joint[old] -= right
            joint[:, old] -= left
            joint[old, old] -= own
            rows, columns = joint.sum(axis=1), joint.sum(axis=0)
            # only neighbours that the type has make a difference
            r, c = np.flatnonzero(right), np.flatnonzero(left)
            across, down = joint[:open_, r], joint[c, :open_]
            gain = (xlogx(across + right[r]) - xlogx(across)).sum(axis=1) + (xlogx(down + left[c, None]) - xlogx(down)).sum(axis=0)
            d = np.diag(joint)[:open_]
            gain += xlogx(d + right[:open_] + left[:open_] + own) + xlogx(d) - xlogx(d + right[:open_]) - xlogx(d + left[:open_])
            more_row, more_col = right.sum() + own, left.sum() + own
            gain -= xlogx(rows[:open_] + more_row) - xlogx(rows[:open_]) + xlogx(columns[:open_] + more_col) - xlogx(columns[:open_])
            new = int(gain.argmax())
            if gain[new] <= gain[old] + 1e-9:
                new = old
            joint[new] += right
            joint[:, new] += left
            joint[new, new] += own
            if new != old:
                moved += 1
                ahead[:, old] -= b[:, t]
                ahead[:, new] += b[:, t]
                behind[:, old] -= b[t]
                behind[:, new] += b[t]
                cls[t] = new
        if not moved:
            break
    return cls


class CoreClasses:
    """The classes of the core words, and what they say of a word with given neighbours."""

    def __init__(self, vocabulary: Vocabulary, bigrams: np.ndarray, classes: int):
        self.v = vocabulary
        self.cls = exchange_classes(bigrams, classes)
        self.k = int(self.cls.max()) + 1
        self.open = self.k - 2
        self.joint = joint = np.zeros((self.k, self.k))
        np.add.at(joint, (self.cls[:, None], self.cls[None, :]), bigrams)
        before = np.log((joint + BIGRAM_ADD) / (joint.sum(axis=0) + BIGRAM_ADD * self.k))[:, : self.open]
        after = np.log((joint + BIGRAM_ADD) / (joint.sum(axis=1, keepdims=True) + BIGRAM_ADD * self.k)).T[:, : self.open]
        #: Log-likelihood that a neighbour (classes before, then classes after) adds if the word is of the class (column).
        self.evidence = np.concatenate([before, after])


def _contexts(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """For each word outside the core, once a piece of text: the numbers of its neighbours by class and side."""
    m = shared.value
    for batch in pieces(batches, most=12 << 20):
        bounds, flat = split_words(batch.column("text"), lower=True)
        codes, words = coded(flat)
        if not len(words):
            continue
        types = m.v.of(words)[codes]
        after, before = m.v.sequence(types, bounds)
        other = np.flatnonzero(types == m.v.other)
        at = other + np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[other]
        sides = 2 * m.k
        event = np.concatenate([codes[other] * sides + m.cls[before[at]], codes[other] * sides + m.k + m.cls[after[at + 1]]])
        event, n = np.unique(event, return_counts=True)
        word = event // sides
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
        packed = ((event % sides) | (n << SIDE_BITS)).astype(np.uint32)
        offsets = (np.append(first, len(word)) * 4).astype(np.int32)
        events = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(packed.tobytes())])
        yield pa.RecordBatch.from_arrays([words.take(pa.array(word[first])).cast(pa.string()), events], names=["word", "events"])


def _assigned(batches: Iterator[pa.RecordBatch], shared, step: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """The count and class of each word; its rows come one after another and are summed, at any number."""
    m = shared.value
    sides = 2 * m.k
    held, last = np.zeros(sides), None

    def of(words: list[str], sums: np.ndarray) -> pa.RecordBatch:
        best = (sums @ m.evidence).argmax(axis=1)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(sums[:, : m.k].sum(axis=1).astype(np.int64)), pa.array(best, pa.int32())], names=["word", "n", "cls"])

    for whole in batches:
        for lo in range(0, whole.num_rows, step):
            batch = whole.slice(lo, step)
            words, events = batch.column("word").to_pylist(), batch.column("events").to_pylist()
            new = np.array([w != v for w, v in zip(words, [last, *words], strict=False)])
            if last is not None and new[0]:
                yield of([last], held[None])
            if new[0]:
                held = np.zeros(sides)
            group = np.cumsum(new) - new[0]  # the first group may have begun before
            packed = np.frombuffer(b"".join(events), np.uint32)
            row = np.repeat(group, [len(e) // 4 for e in events])
            size = int(group[-1]) + 1
            sums = np.bincount(row * sides + (packed & ((1 << SIDE_BITS) - 1)), weights=packed >> SIDE_BITS, minlength=size * sides).reshape(size, sides)
            sums[0] += held
            names = [words[0], *(w for w, n in zip(words[1:], new[1:], strict=True) if n)]
            if size > 1:
                yield of(names[:-1], sums[:-1])
            held, last = sums[-1], names[-1]
    if last is not None:
        yield of([last], held[None])


class Emissions:
    """Counts and classes of the frequent words and, by class, log10 of what a word's count is divided by.

    An unseen word takes the class in which it is likeliest after the class before it.
    """

    def __init__(self, words: list[str], counts: list[int], classes: list[int], size: np.ndarray, kinds: np.ndarray, ends: int, core: CoreClasses):
        self.keys = pa.array(words, pa.large_string())
        self.counts, self.classes = np.array(counts, np.int64), np.array(classes, np.int64)
        self.end, self.k, self.ends = len(size), len(size) + 1, ends
        self.divisor = np.log10(size + WORD_ADD * (kinds + 1))
        rows = core.joint[[*range(len(size)), core.k - 1], : len(size)] + BIGRAM_ADD
        self.unseen = (np.log10(rows) - self.divisor).argmax(axis=1)


def _runs(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The bytes of the values between consecutive bounds."""
    offsets = (bounds * values.dtype.itemsize).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())]).cast(pa.binary())


def pair_counts(doc: np.ndarray, pair: np.ndarray, n: np.ndarray | None, docs: int, kinds: int) -> pa.Array:
    """For each document its distinct pairs and their numbers, interleaved; a larger number takes more than one entry."""
    key, inverse = np.unique(doc * kinds + pair, return_inverse=True)
    times = np.bincount(inverse, weights=n, minlength=len(key)).astype(np.int64)
    if (times > MOST_TIMES).any():
        parts = -(-times // MOST_TIMES)
        last = np.cumsum(parts) - 1
        key, rest = np.repeat(key, parts), times - (parts - 1) * MOST_TIMES
        times = np.full(len(key), MOST_TIMES)
        times[last] = rest
    flat = np.stack([key % kinds, times], axis=1).astype(np.uint16).ravel()
    return _runs(flat, 2 * np.searchsorted(key // kinds, np.arange(docs + 1)))


def pairs_of(raw: list[bytes]) -> np.ndarray:
    """Pairs and numbers (columns) of all documents, one after another."""
    return np.frombuffer(b"".join(raw), np.uint16).reshape(-1, 2).astype(np.int64)


TEXT = pa.struct(
    [("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("emitted", pa.float64()), ("pairs", pa.binary()), ("open", pa.binary())]
)
PARTS = "id bigint, h bigint, word string, use bigint, text struct<train boolean, n_tokens bigint, n_known bigint, base double, emitted double, pairs binary, open binary>"


def _parts(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """A row for each text with what its frequent words say, and a row for each of its distinct other words.

    Words outside the frequent ones are numbered as they first appear in the text, from 0 on; ``use`` has that number
    above its lower half, which says how often the text has the word. ``open`` has the transitions that they take
    part in: a class, or minus the number less one. Texts have no ``use``, and a ``word`` that no word is.
    """
    m = shared.value
    for batch in pieces(batches):
        bounds, flat = split_words(batch.column("text"), lower=True)
        codes, words = coded(flat)
        size = np.diff(bounds)
        docs = len(size)
        if not docs:
            continue
        place = found(words, m.keys, -1)
        seen = place >= 0
        count = np.where(seen, m.counts[place] if len(m.counts) else 0, 0)
        cls = np.where(seen, m.classes[place] if len(m.classes) else 0, 0)
        base = np.where(seen, np.log10(count + 1.0), 0.0)
        emitted = np.where(seen, np.log10(count + WORD_ADD) - m.divisor[cls], 0.0)
        of = np.repeat(np.arange(docs), size)
        rare = np.flatnonzero(~seen[codes]) if len(words) else np.zeros(0, np.int64)
        pairs, first, inverse, uses = np.unique(of[rare] * max(1, len(words)) + codes[rare], return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(first, kind="stable")
        owner = of[rare][first[order]]
        number = np.arange(len(order)) - np.searchsorted(owner, np.arange(docs))[owner]
        at = np.zeros(len(order), np.int64)
        at[order] = number
        token = cls[codes] if len(words) else np.zeros(0, np.int64)
        token[rare] = -1 - at[inverse]
        after = np.insert(token, bounds[1:], m.end)
        ends = bounds + np.arange(docs + 1)
        before = np.concatenate([[m.end], after[:-1]])
        doc = np.repeat(np.arange(docs), size + 1)
        known = (before >= 0) & (after >= 0)
        loose = np.flatnonzero(~known)
        transitions = np.stack([before[loose], after[loose]], axis=1).astype(np.int32).ravel()
        sums = lambda x: segment_sums(x[codes] if len(words) else np.zeros(0, x.dtype), bounds)
        blank = pa.nulls(len(order), TEXT)
        texts = pa.StructArray.from_arrays(
            [
                batch.column("train"),
                pa.array(size + 1, pa.int64()),
                pa.array(sums(seen.astype(np.int64)) + (m.ends > 0), pa.int64()),
                pa.array(sums(base) + np.log10(m.ends + 1.0)),
                pa.array(sums(emitted)),
                pair_counts(doc[known], before[known] * m.k + after[known], None, docs, m.k * m.k),
                _runs(transitions, 2 * np.searchsorted(loose, ends)),
            ],
            fields=list(TEXT),
        )
        of_text = pa.array(np.concatenate([np.arange(docs), owner]))
        keys = pa.array([f"{h:x}\n" for h in batch.column("h").to_pylist()], pa.string())
        names = words.take(pa.array(codes[rare][first[order]])).cast(pa.string()) if len(order) else pa.array([], pa.string())
        use = pa.concat_arrays([pa.nulls(docs, pa.int64()), pa.array(number << 32 | uses[order])])
        yield pa.RecordBatch.from_arrays([batch.column("id").take(of_text), batch.column("h").take(of_text), pa.concat_arrays([keys, names]), use, pa.concat_arrays([texts, blank])], names=["id", "h", "word", "use", "text"])


def _joined(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Texts with the classes and counts of their rarer words worked in."""
    m = shared.value
    for whole in batches:
        for lo in range(0, whole.num_rows, 1000):
            batch = whole.slice(lo, 1000)
            docs = batch.num_rows
            lists = batch.column("rest")
            doc = np.repeat(np.arange(docs), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            rest = lists.flatten()
            use, known = (pc.fill_null(rest.field(c), -1).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("use", "known"))
            # repeated rows have brought their words more than once
            key, one = np.unique(doc << 32 | use >> 32, return_index=True)
            doc, uses, known = doc[one], use[one] & 0xFFFFFFFF, known[one]
            n, cls = np.where(known >= 0, known >> 8, 0), np.where(known >= 0, known & 255, -1)
            starts = np.searchsorted(key >> 32, np.arange(docs))
            sums = lambda x: np.bincount(doc, weights=x, minlength=docs)
            text = batch.column("text")
            raw = text.field("open").to_pylist()
            loose = np.frombuffer(b"".join(raw), np.int32).reshape(-1, 2).astype(np.int64)
            of = np.repeat(np.arange(docs), [len(x) // 8 for x in raw])
            ends = [np.where(x >= 0, x, cls[np.clip(starts[of] - 1 - x, 0, len(cls) - 1)] if len(cls) else 0) for x in loose.T]
            unseen = np.flatnonzero(ends[1] < 0)
            left = unseen
            while len(left):  # after each other, runs of unseen words in step; the next transition begins where one ends
                ready = left[ends[0][left] >= 0]
                ends[1][ready] = m.unseen[ends[0][ready]]
                ends[0][ready + 1] = ends[1][ready]
                left = left[ends[1][left] < 0]
            new = np.bincount(of[unseen], weights=np.log10(WORD_ADD) - m.divisor[ends[1][unseen]], minlength=docs)
            raw = text.field("pairs").to_pylist()
            known = pairs_of(raw)
            owner = np.repeat(np.arange(docs), [len(x) // 4 for x in raw])
            all_pairs = pair_counts(np.concatenate([of, owner]), np.concatenate([ends[0] * m.k + ends[1], known[:, 0]]), np.concatenate([np.ones(len(of)), known[:, 1]]), docs, m.k * m.k)
            number = lambda c: text.field(c).to_numpy(zero_copy_only=False)
            out = pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    text.field("train"),
                    text.field("n_tokens"),
                    pa.array((number("n_known") + sums(uses * (n > 0))).astype(np.int64)),
                    pa.array(number("base") + sums(uses * np.log10(n + 1.0))),
                    pa.array(number("emitted") + new + sums(np.where(n > 0, uses * (np.log10(n + WORD_ADD) - m.divisor[cls]), 0.0))),
                    all_pairs,
                ],
                names=["id", "train", "n_tokens", "n_known", "base", "emitted", "pairs"],
            )
            copies = batch.column("copies").to_numpy(zero_copy_only=False)
            yield out if (copies == 1).all() else out.take(pa.array(np.repeat(np.arange(docs), copies)))


def _transitions(batches: Iterator[pa.RecordBatch], kinds: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(kinds, np.int64)
    for batch in batches:
        known = pairs_of(batch.column("pairs").to_pylist())
        np.add.at(total, known[:, 0], known[:, 1])
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], names=["pair", "n"])


def word_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """``(word, n)`` over all rows, A-Z lower-cased."""
    return texts.select(F.col(text).cast("string").alias("text")).mapInArrow(_counts, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def least_count(counts: DataFrame, most: int) -> tuple[int, int, int]:
    """The least count of the upper count bands that hold at most ``most`` words, and the sums of all words and counts.

    Bands are eighths of powers of two, so that the driver sees a few hundred rows.
    """
    band = F.floor(8 * F.log2("n"))
    bands = counts.groupBy(band.alias("band")).agg(F.min("n").alias("least"), F.count("*").alias("kinds"), F.sum("n").alias("n")).orderBy(F.desc("band")).collect()
    words, least = 0, 1 << 62
    for r in bands:
        words += r["kinds"]
        if words > most:
            break
        least = r["least"]
    return least, sum(r["kinds"] for r in bands), sum(r["n"] for r in bands)


def word_classes(train: DataFrame, text: str = "text", core: int = CORE, most_frequent: int = FREQUENT) -> tuple[DataFrame, CoreClasses, int, int, int]:
    """``(word, n, cls)`` of every word of ``train``, the core's classes, the least count of at most ``most_frequent``
    words, and the sums of words and counts.

    The driver gets the ``core`` words and the bigrams of ``core`` + 2 types. Every other word meets its neighbours'
    classes, summed within pieces of text first, in one shuffle.
    """
    spark = train.sparkSession
    texts = train.select(F.col(text).cast("string").alias("text"))
    counts = cut(word_counts(train, text))
    least, distinct, tokens = least_count(counts, most_frequent)
    inner = [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(core).collect()]
    v = Vocabulary(inner)
    shared = spark.sparkContext.broadcast(v)
    pairs = texts.mapInArrow(lambda it: _bigrams(it, shared), "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    bigrams = np.zeros(v.types * v.types, np.int64)
    bigrams[pairs["pair"].to_numpy()] = pairs["n"].to_numpy()
    bigrams = bigrams.reshape(v.types, v.types)
    classes = CoreClasses(v, bigrams, min(MOST_CLASSES, max(2, round(distinct**CLASS_POWER))))
    known = spark.sparkContext.broadcast(classes)
    rest = texts.mapInArrow(lambda it: _contexts(it, known), "word string, events binary")
    rest = rest.repartition("word").sortWithinPartitions("word").mapInArrow(lambda it: _assigned(it, known), "word string, n bigint, cls int")
    size = bigrams.sum(axis=0)
    own = spark.createDataFrame([(w, int(size[i]), int(classes.cls[i])) for i, w in enumerate(inner)], "word string, n bigint, cls int")
    return cut(rest.unionByName(own)), classes, least, distinct, tokens


def class_model_scores(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", core: int = CORE, most_frequent: int = FREQUENT) -> DataFrame:
    """``(id_col, n_tokens, n_known, train_tokens, base_score, score)`` of every row of ``df``; a null text is empty.

    The model learns from the rows where ``train`` is true. Frequent words are scored where the text is read. Other
    ones, counted within each text first, meet their counts and classes in one equi-join; the parts of a text come
    together by its id and a hash of it, which a task that runs again computes alike.
    """
    spark = df.sparkSession
    text = F.col(text_col).cast("string")
    name = F.col(id_col).cast("long")
    # half a hash tells the texts of one id apart
    h = F.when(name.isNull(), F.xxhash64(text)).otherwise(F.shiftrightunsigned(F.xxhash64(text), 32))
    rows = df.select(name.alias("id"), h.alias("h"), F.coalesce(train, F.lit(False)).alias("train"), text.alias("text"))
    learned = rows.where("train").select("text")
    ends = learned.count()
    classes, inner, least, distinct, tokens = word_classes(learned, "text", core, most_frequent)
    k = inner.open
    size, kinds = np.zeros(k), np.zeros(k)
    for r in classes.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect():
        size[r["cls"]], kinds[r["cls"]] = r["n"], r["kinds"]
    top = classes.where(F.col("n") >= least).toArrow()
    emissions = Emissions(top["word"].to_pylist(), top["n"].to_pylist(), top["cls"].to_pylist(), size, kinds, ends, inner)
    shared = spark.sparkContext.broadcast(emissions)
    parts = rows.mapInArrow(lambda it: _parts(it, shared), PARTS)
    rarer = classes.where(F.col("n") < least).select("word", F.shiftleft("n", 8).bitwiseOR(F.col("cls").cast("long")).alias("known"))
    parts = parts.join(rarer, "word", "left").select("id", "h", "use", "known", "text")
    texts = parts.groupBy("id", "h").agg(
        F.count("text").alias("copies"), F.first("text", ignorenulls=True).alias("text"), F.collect_list(F.when(F.col("use").isNotNull(), F.struct("use", "known"))).alias("rest")
    )
    texts = cut(texts.mapInArrow(lambda it: _joined(it, shared), "id bigint, train boolean, n_tokens bigint, n_known bigint, base double, emitted double, pairs binary"))
    k = emissions.k
    joint = np.zeros(k * k)
    for r in texts.where("train").select("pairs").mapInArrow(lambda it: _transitions(it, k * k), "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        joint[r["pair"]] = r["n"]
    follows = class_transitions(joint.reshape(k, k))
    of_model = spark.sparkContext.broadcast(np.log10(follows).ravel())

    def transitions(pairs: pa.Array) -> pa.Array:
        raw = pairs.to_pylist()
        known = pairs_of(raw)
        return pa.array(segment_sums(known[:, 1] * of_model.value[known[:, 0]], np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw], dtype=np.int64)])))

    total, distinct = tokens + ends, distinct + (ends > 0)
    floor = float(np.log10(total + distinct + 1))
    score = F.col("emitted") + F.arrow_udf(transitions, "double")(F.col("pairs"))
    return texts.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * floor).alias("base_score"), score.alias("score"))


def class_transitions(joint: np.ndarray) -> np.ndarray:
    """The probability of each class (column) after each class, smoothed by the classes' own frequencies."""
    k = len(joint)
    follows = (joint + BIGRAM_ADD) / (joint.sum(axis=1, keepdims=True) + BIGRAM_ADD * k)
    alone = (joint.sum(axis=0) + BIGRAM_ADD) / (joint.sum() + BIGRAM_ADD * k)
    return (1 - UNIGRAM_SHARE) * follows + UNIGRAM_SHARE * alone
