"""Language ID with interpolated Kneser-Ney character models.

One character model per language over words (with their borders), orders 1 to 5. The n-grams of languages share
sorted hash arrays, one per order, with a column of log probabilities and back-off weights per language, in blocks of 8
languages that are scored one after the other. Every lang value is learned. A text goes to
the language of the lowest cross-entropy per character over all its words. Confidence is the softmax of the
cross-entropies at a temperature fitted on held-back training rows; a text is rejected if it has no letter or if its
cross-entropy is far above what its language showed on those rows.

Fitting takes about train_docs distinct texts of each language, chosen by a hash, and the whole texts of these;
predictions read whole texts and nothing but texts. Edge cases: null, empty and letterless texts get `und`, score 0
and are rejected; equal cross-entropies go to the language first in order; repeated rows are judged row by row; rows
with a null id keep it; with no labelled row at all every text gets `und` and only
letterless ones are rejected; columns of docs that are named as a result give way to it, all other names are free; no
rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LETTERS, bounded_batches, fmix64, free_name, materialize, words_of

ORDER = 5
#: Words that a Python worker remembers; beyond it the memory starts anew.
MEMORY = 200_000
#: Languages whose n-grams share tables; beyond so many, texts are scored in blocks of languages.
BLOCK = 8
#: Bytes of tables up to which a worker keeps all blocks; above, it loads them in turn for each batch.
HELD = 256 << 20
TEMPERATURES = (0.02, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_EDGE = 10  # the code that stands for the border of a word


def _codes(words: list[bytes]) -> np.ndarray:
    """Lower-cased code points of words with a border before, between and after them."""
    text = b"\n" + b"\n".join(words) + b"\n"
    return np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le"), np.uint32)


def _grams(codes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """hash[n][i] of the n codes that end at i, and how many codes of the word, border included, end at i."""
    spread = fmix64(codes.astype(np.uint64) + np.uint64(1))
    hashes, run = [np.zeros(len(codes), np.uint64)], np.zeros(len(codes), np.uint64)
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(ORDER - 1, _STEP)]))
    for n in range(1, ORDER + 1):
        moved = np.zeros(len(codes), np.uint64)
        moved[n - 1 :] = spread[: len(codes) - n + 1]
        run = run + moved * powers[n - 1]
        hashes.append(fmix64(run + np.uint64(n)))
    at = np.arange(len(codes))
    last = np.maximum.accumulate(np.where(codes == _EDGE, at, 0))
    before = np.empty(len(codes), np.int64)
    before[0], before[1:] = 0, last[:-1]
    return hashes, at - before + 1


@dataclass
class Model:
    languages: list[str]
    grams: list[np.ndarray]  # per order: sorted hashes
    logp: list[np.ndarray]  # per order: log probability for each language
    contexts: list[np.ndarray]  # per order: sorted hashes of the contexts
    backoff: list[np.ndarray]  # per order: log weight for each language
    unknown: np.ndarray

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for part in (self.grams, self.logp, self.contexts, self.backoff) for x in part)

    def words(self, words: list[bytes]) -> np.ndarray:
        """Per word: the log probability under each language, then the number of characters and the end."""
        if not words:
            return np.empty((0, len(self.languages) + 1), np.float64)
        codes = _codes(words)
        hashes, have = _grams(codes)
        at = np.arange(1, len(codes))
        total = np.zeros((len(at), len(self.languages)))
        done = np.zeros(len(at), bool)
        for n in range(ORDER, 0, -1):
            open_ = np.flatnonzero(~done & (have[at] >= n))
            gram, context = hashes[n][at[open_]], hashes[n - 1][at[open_] - 1]
            place = np.minimum(np.searchsorted(self.grams[n], gram), len(self.grams[n]) - 1)
            found = self.grams[n][place] == gram
            total[open_[found]] += self.logp[n][place[found]]
            done[open_[found]] = True
            open_, context = open_[~found], context[~found]
            place = np.minimum(np.searchsorted(self.contexts[n], context), len(self.contexts[n]) - 1)
            known = self.contexts[n][place] == context
            total[open_[known]] += self.backoff[n][place[known]]
        total[~done] += self.unknown
        ends = np.flatnonzero(codes[1:] == _EDGE) + 1  # the codes of word w are at ends[w - 1] .. ends[w] - 1
        starts = np.concatenate([[0], ends[:-1]])
        return np.column_stack([np.add.reduceat(total, starts, axis=0), np.diff(np.append(starts, len(at)))])


def fit_counts(counts: dict[str, tuple[list[bytes], np.ndarray]], symbols: int) -> Model:
    """Kneser-Ney models from the word counts of each language; symbols is one more than all languages have characters.

    A language's model depends on its own counts and symbols only, so blocks of languages can be fitted apart.
    """
    languages = sorted(counts)
    table: dict[int, list] = {n: [] for n in range(1, ORDER + 1)}
    for words, times in (counts[x] for x in languages):
        codes = _codes(words)
        hashes, have = _grams(codes)
        at = np.arange(1, len(codes))
        word = np.cumsum(codes == _EDGE)[at - 1] - 1
        times = times[word]
        wider: tuple[np.ndarray, np.ndarray] | None = None  # the longer grams: first places
        for n in range(ORDER, 0, -1):
            mine = at[have[at] >= n]
            gram, first, back = np.unique(hashes[n][mine], return_index=True, return_inverse=True)
            place = mine[first]
            raw = np.bincount(back, weights=times[mine - 1], minlength=len(gram))
            if n == ORDER:
                count = raw
            else:  # how many different characters come before it; at the start of a word how often it occurs
                below = np.searchsorted(gram, hashes[n][wider])
                count = np.bincount(below, minlength=len(gram)).astype(float)
                count = np.where(have[place] == n, raw, count)
            wider = place
            table[n].append((gram, hashes[n - 1][place - 1], hashes[n - 1][place], count))
    size = len(languages)
    grams, logp, contexts, backoff = [np.empty(0, np.uint64)], [np.empty((0, size))], [np.empty(0, np.uint64)], [np.empty((0, size))]
    lower = np.full((1, size), 1 / symbols)
    for n in range(1, ORDER + 1):
        every = np.concatenate([x[0] for x in table[n]])
        gram, first = np.unique(every, return_index=True)
        context = np.concatenate([x[1] for x in table[n]])[first]
        suffix = np.concatenate([x[2] for x in table[n]])[first]
        count = np.zeros((len(gram), size))
        for x, (own, _, _, c) in enumerate(table[n]):
            count[np.searchsorted(gram, own), x] = c
        ctx, of = np.unique(context, return_inverse=True)
        once, twice = (count == 1).sum(0), (count == 2).sum(0)
        discount = np.clip(once / np.maximum(once + 2 * twice, 1), 0.1, 0.95)
        total, kinds = np.zeros((len(ctx), size)), np.zeros((len(ctx), size))
        np.add.at(total, of, count)
        np.add.at(kinds, of, count > 0)
        weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        below = lower if n == 1 else np.exp(logp[n - 1])[np.searchsorted(grams[n - 1], suffix)]
        p = np.maximum(count - discount, 0) / np.maximum(total, 1)[of] + weight[of] * below
        grams.append(gram), logp.append(np.log(p)), contexts.append(ctx), backoff.append(np.log(weight))
    return Model(languages, grams, logp, contexts, backoff, np.log(lower[0]))


class Reader:
    """Scores whole texts, remembering the words it has met."""

    def __init__(self, model: Model, memory: int = MEMORY):
        self.model, self.memory = model, memory
        self._forget()

    def _forget(self):
        self.keys, self.values = np.empty(0, np.uint64), np.empty((0, len(self.model.languages) + 1))

    def texts(self, column: pa.Array) -> np.ndarray:
        """Per text: summed log probability under each language, then characters, then words."""
        out = []
        for w in words_of(column, LETTERS):
            keys, first, back = np.unique(w.hash, return_index=True, return_inverse=True)
            place = np.searchsorted(self.keys, keys)
            new = np.ones(len(keys), bool)
            inside = place < len(self.keys)
            new[inside] = self.keys[place[inside]] != keys[inside]
            values = np.empty((len(keys), self.values.shape[1]))
            values[~new] = self.values[place[~new]]
            at = first[new].tolist()
            values[new] = self.model.words([w.data[w.start[i] : w.end[i]].tobytes() for i in at])
            if len(self.keys) + len(at) > self.memory:
                self._forget()
                place = np.zeros(len(keys), np.int64)
            self.keys = np.insert(self.keys, place[new], keys[new])
            self.values = np.insert(self.values, place[new], values[new], axis=0)
            sums = np.zeros((len(w.hash) + 1, values.shape[1]))
            np.cumsum(values[back], axis=0, out=sums[1:])
            out.append(np.column_stack([sums[w.first[1:]] - sums[w.first[:-1]], w.counts]))
        return np.concatenate(out) if out else np.empty((0, self.values.shape[1] + 1))


@dataclass
class Languages:
    """All learned languages in order, in broadcast blocks, and what calibration found."""

    languages: list[str]
    blocks: list[Broadcast]
    held: bool
    temperature: float
    mean: np.ndarray
    spread: np.ndarray


class Scorer:
    """Scores texts by one block of languages after the other."""

    def __init__(self, blocks: list[Broadcast], held: bool):
        self.blocks, self.held = blocks, held
        self.kept: dict[int, Reader] = {}

    def _reader(self, b: int) -> Reader:
        if self.held:
            return self.kept.get(b) or self.kept.setdefault(b, Reader(self.blocks[b].value, MEMORY // len(self.blocks)))
        block = self.blocks[b]
        reader = Reader(block.value)
        if getattr(block, "_path", None):  # the next value is read from the file again
            del block._value
        return reader

    def entropies(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Per block: its first language's number, cross-entropies (texts x languages), characters, words."""
        lo = 0
        for b in range(len(self.blocks)):
            reader = self._reader(b)
            sums, size = reader.texts(column), len(reader.model.languages)
            yield lo, -sums[:, :size] / np.maximum(sums[:, size : size + 1], 1), sums[:, size], sums[:, size + 1]
            lo += size


def _soft(entropy: np.ndarray, temperature: float) -> np.ndarray:
    return np.logaddexp.reduce(-entropy / temperature, axis=1)


def _sample(docs: DataFrame, train_docs: int) -> DataFrame:
    """About train_docs distinct texts of each language: text, lang, part (0: fit, 1: calibrate).

    Copies count once and are drawn once, so the share is one of distinct texts; they are dropped before they move. A
    language of which no text would be in part 0 has all of its texts there.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    distinct = labelled.groupBy("lang", F.xxhash64("text").alias("hash")).agg(F.count("*").alias("copies"))
    share = materialize(distinct.groupBy("lang").agg((F.lit(float(train_docs)) / F.count("*")).alias("share")), "shares")
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    picked = labelled.join(F.broadcast(share), "lang").where(draw < F.col("share")).groupBy("lang", "text").agg(F.max((F.pmod(F.hash("text"), F.lit(5)) == 0).cast("int")).alias("part"))
    picked = materialize(picked.select("text", "lang", "part"), "sample")
    least = picked.groupBy("lang").agg(F.min("part").alias("least"))
    return picked.join(F.broadcast(least), "lang").select("text", "lang", (F.col("part") - F.col("least")).alias("part"))


def _word_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for w in words_of(batch.column("text"), LETTERS):
            key = np.stack([w.owner().astype(np.uint64), w.hash], 1)
            _, first, times = np.unique(key, axis=0, return_index=True, return_counts=True) if len(key) else (0, np.empty(0, int), np.empty(0, int))
            owner = w.owner()[first].tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([langs[w.lo + d] for d in owner], pa.string()), pa.array([w.data[w.start[i] : w.end[i]].tobytes() for i in first.tolist()], pa.binary()), pa.array(times, pa.int64())],
                ["lang", "word", "times"],
            )


def _characters(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = np.unique(_codes(batch.column("word").to_pylist())) if len(batch) else np.empty(0, np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64))], ["code"])


def train(docs: DataFrame, train_docs: int = 400) -> Languages:
    """Fits and calibrates on about train_docs documents of each language of docs (text, lang), whatever their number."""
    spark = docs.sparkSession
    bounded_batches(spark)
    sample = _sample(docs, train_docs)
    counts = sample.where("part = 0").mapInArrow(_word_counts, "lang string, word binary, times long").groupBy("lang", "word").agg(F.sum("times").alias("times"))
    counts = materialize(counts, "words")
    languages = sorted(r.lang for r in counts.select("lang").distinct().collect())
    symbols = max(2, counts.select("word").mapInArrow(_characters, "code long").distinct().count()) + 1
    blocks, size = [], 0
    for lo in range(0, len(languages), BLOCK):
        names = languages[lo : lo + BLOCK]
        table = counts.where(F.col("lang").isin(names)).toArrow().to_pandas()  # words of BLOCK times train_docs texts
        model = fit_counts({x: (list(map(bytes, t["word"])), t["times"].to_numpy(float)) for x, t in table.groupby("lang")}, symbols)
        size += model.nbytes
        blocks.append(spark.sparkContext.broadcast(model))
    learned = Languages(languages, blocks, size <= HELD, 1.0, np.full(len(languages), 4.0), np.full(len(languages), 4.0))
    if languages:
        _calibrate(learned, sample.where("part = 1").select("text", "lang"))
    return learned


def _calibrate(learned: Languages, rows: DataFrame) -> None:
    """Temperature by log loss; per language the mean and spread of the cross-entropy, scaled to one word."""
    blocks, held = learned.blocks, learned.held
    numbers = rows.sparkSession.sparkContext.broadcast({x: i for i, x in enumerate(learned.languages)})

    def score(batches):
        scorer = Scorer(blocks, held)
        for batch in batches:
            if not len(batch):
                continue
            langs = np.array([numbers.value.get(x, -1) for x in batch.column("lang").to_pylist()], int)
            own, soft = np.zeros(len(langs)), np.full((len(langs), len(TEMPERATURES)), -np.inf)
            for lo, entropy, letters, words in scorer.entropies(batch.column("text")):
                mine = np.flatnonzero((langs >= lo) & (langs < lo + entropy.shape[1]))
                own[mine] = entropy[mine, langs[mine] - lo]
                for i, t in enumerate(TEMPERATURES):
                    soft[:, i] = np.logaddexp(soft[:, i], _soft(entropy, t))
            loss = own[:, None] / np.array(TEMPERATURES) + soft
            good = (langs >= 0) & (letters > 0)
            yield pa.RecordBatch.from_arrays([pa.array(langs[good]), pa.array(own[good]), pa.array(words[good]), pa.array(loss[good].tolist(), pa.list_(pa.float64()))], ["number", "own", "words", "loss"])

    seen = rows.mapInArrow(score, "number long, own double, words double, loss array<double>").toArrow()
    if not len(seen):
        return
    langs, own, words = (seen.column(c).to_numpy() for c in ("number", "own", "words"))
    learned.temperature = TEMPERATURES[int(np.array(seen.column("loss").to_pylist()).mean(0).argmin())]
    order = np.argsort(langs, kind="stable")
    for mine in np.split(order, np.flatnonzero(np.diff(langs[order])) + 1):
        if len(mine) >= 5:
            x = langs[mine[0]]
            learned.mean[x] = np.median(own[mine])
            learned.spread[x] = np.sqrt(np.median((own[mine] - learned.mean[x]) ** 2 * words[mine])) * 1.5 + 0.1


def identify(docs: DataFrame, learned: Languages, tolerance: float = 12.0) -> DataFrame:
    """All columns of docs and language, confidence (0 to 1), rejected.

    Rejected: no letter, or a cross-entropy over its language's usual one by tolerance spreads (of one word, over the
    root of the number of words) and one nat.
    """
    bounded_batches(docs.sparkSession)
    blocks, held = learned.blocks, learned.held
    shared = docs.sparkSession.sparkContext.broadcast((np.array(learned.languages, object), learned.temperature, learned.mean, learned.spread))
    scorers: dict[int, Scorer] = {}

    @F.pandas_udf("struct<language:string,confidence:double,rejected:boolean>")
    def judge(texts):
        import pandas as pd

        scorer = scorers.get(0) or scorers.setdefault(0, Scorer(blocks, held))
        names, temperature, mean, spread = shared.value
        best, least, soft = np.zeros(len(texts), int), np.full(len(texts), np.inf), np.full(len(texts), -np.inf)
        words = np.zeros(len(texts))
        for lo, entropy, _, words in scorer.entropies(pa.Array.from_pandas(texts, type=pa.string())):
            first = entropy.argmin(1)
            here = entropy[np.arange(len(first)), first]
            best, least = np.where(here < least, lo + first, best), np.minimum(here, least)
            soft = np.logaddexp(soft, _soft(entropy, temperature))
        confidence = np.exp(-least / temperature - soft)
        far = least > mean[best] + 1.0 + tolerance * spread[best] / np.sqrt(np.maximum(words, 1))
        return pd.DataFrame({"language": names[best], "confidence": confidence, "rejected": far})

    rest = [c for c in docs.columns if c.lower() not in ("language", "confidence", "rejected")]
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if not learned.languages:
        return docs.select(*rest, F.lit("und").alias("language"), F.lit(0.0).alias("confidence"), (~lettered).alias("rejected"))
    judged = free_name("judged", docs.columns)
    found = docs.select(*rest, F.struct(judge("text").alias("x"), lettered.alias("lettered")).alias(judged))
    x, lettered = F.col(judged)["x"], F.col(judged)["lettered"]
    return found.select(
        *rest,
        F.when(lettered, x["language"]).otherwise("und").alias("language"),
        F.when(lettered, x["confidence"]).otherwise(0.0).alias("confidence"),
        (~lettered | x["rejected"]).alias("rejected"),
    )


def keep_known(docs: DataFrame, learned: Languages, **options) -> DataFrame:
    """The rows of docs, with all their columns, that identify() does not reject."""
    row = docs.select("text", F.struct("*").alias("row"))
    return identify(row, learned, **options).where("not rejected").select("row.*")
