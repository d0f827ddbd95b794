"""Operator 10, language ID: interpolated Kneser-Ney character models, one for each language.

The models learn from a bounded sample of the labelled training rows: per language some `sample_docs` documents or
`sample_chars` characters, whichever is less, and `most_docs` over all languages, whole texts, chosen by a hash of doc_id and
text (a documented bound; every document is scored). Spark counts the sample's character 4-grams by language; the counts
fit in one table that is bounded with the sample, from which the interpolated probabilities are computed. They are kept
as sorted arrays of 64-bit n-gram keys (16 bits a character) with one column a language, over the n-grams of all
languages, and are looked up by binary search; an n-gram of no language backs off to the next order with its context's
weights. A text gets the language of least cross-entropy a character.

Rejection is calibrated for each language on the third of its sample that is held back from learning. How far a document's
cross-entropy exceeds the language's mean is measured in standard deviations for its length (a part that all documents
have, and a part that falls with the number of characters, of the mean's square at least, as few short documents tell little
of it). The limit is what at most a share `false_rejection` of such
documents exceeds, by the largest of three counts: with their upper tenth's tail taken as exponential, by Student's t for
as many calibration documents, and the quantile of the documents themselves. Beyond the limit a text is rejected.

Defined results: a null text, or one without letters, is `und` with score 0 and is rejected; without any training row
every text is `und`; a null doc_id isn't held out; ties go to the language that comes first; repeated rows get equal
values; an empty table gives an empty result; long texts are taken whole, one by one; other columns are ignored, and pass
through `keep_identified`, whatever their names. lang, source and doc_id are never inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import byte_sizes, grouped
from .common import stored, table

ORDER = 4
SPACE = 32
#: Bytes of text that a task scores at once.
GROUP = 1 << 20


def letter_table() -> np.ndarray:
    """For each code point: the 16-bit symbol of its lower-case letter, or 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint16)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 and ord(low) < 0xFFFF else 0xFFFF
    return out


_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(letter_table())
    return _LETTERS[0]


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, owner): the texts' letters with one space for each run of other characters, and the text of each.

    Every text begins with one space, which is context only and not scored."""
    lens = np.array([len(t) for t in texts])
    codes = np.frombuffer(" ".join(["", *texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = letters()[codes]
    owner = np.repeat(np.arange(len(texts)), lens + 1)
    first = np.zeros(len(out), bool)
    first[np.cumsum(lens + 1) - lens - 1] = True
    gap = out == 0
    keep = ~gap | first | ~np.append(True, gap[:-1])
    out = np.where(gap, SPACE, out)
    return out[keep].astype(np.uint64), owner[keep]


def contexts(sym: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The key of the 4-gram that ends at each position; places before a text's begin are spaces."""
    key = sym.copy()
    for back in range(1, ORDER):
        before = np.full(len(sym), SPACE, np.uint64)
        same = owner[back:] == owner[:-back]
        before[back:][same] = sym[:-back][same]
        key |= before << np.uint64(16 * back)
    return key


def scored(owner: np.ndarray) -> np.ndarray:
    """Positions that count: all but the first of each text."""
    return np.flatnonzero(np.append(False, owner[1:] == owner[:-1]))


def low(keys: np.ndarray, n: int) -> np.ndarray:
    """The last n characters of each key."""
    return keys & np.uint64((1 << 16 * n) - 1)


#: Calibration documents from which on the spread is told by length.
FEW = 30


def student_quantile(freedom: int, tail: float) -> float:
    """What a Student-t variable exceeds with probability `tail`; without a degree of freedom, infinity."""
    if freedom < 1:
        return np.inf
    angle = np.linspace(0, np.pi / 2, 1 << 18, endpoint=False)
    above = np.cumsum(np.cos(angle[::-1]) ** (freedom - 1))[::-1]
    at = np.searchsorted(-above, -tail * 2 * above[0])
    return np.sqrt(freedom) * np.tan(angle[min(at, len(angle) - 1)])


class Models:
    """Interpolated Kneser-Ney probabilities of all languages. For n = 1..4: grams[n] (sorted keys) with logp[n]
    (gram, language); for n = 2..4: heads[n] (sorted keys of n-1 characters) with back[n] (context, language)."""

    def __init__(self, languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        """counts: for each language, 4-gram keys and how often they occur."""
        self.languages = languages
        size = len(languages)
        # Lower orders count the distinct characters that stand before, from the n-grams of the order above.
        levels = {ORDER: [(k, c.astype(float)) for k, c in ((np.unique(k), c[np.argsort(k)]) for k, c in counts)]}
        for n in range(ORDER - 1, 0, -1):
            levels[n] = []
            for keys, _ in levels[n + 1]:
                k, c = np.unique(low(keys, n), return_counts=True)
                levels[n].append((k, c.astype(float)))
        self.grams, self.logp, self.heads, self.back = {}, {}, {}, {}
        below = None
        for n in range(1, ORDER + 1):
            grams = np.unique(np.concatenate([k for k, _ in levels[n]]))
            prob = np.zeros((len(grams), size))
            if n > 1:
                heads = np.unique(grams >> np.uint64(16))
                back = np.ones((len(heads), size))
                suffix = np.searchsorted(self.grams[n - 1], low(grams, n - 1))
                head_of = np.searchsorted(heads, grams >> np.uint64(16))
            for j, (keys, c) in enumerate(levels[n]):
                ones, twos = (c == 1).sum(), (c == 2).sum()
                d = ones / (ones + 2 * twos) if ones and twos else 0.5
                at = np.searchsorted(grams, keys)
                if n == 1:
                    total = max(c.sum(), 1.0)
                    prob[:, j] = d * len(keys) / total / (len(grams) + 1) if len(keys) else 1 / (len(grams) + 1)
                    prob[at, j] += (c - d) / total
                    self.unseen = getattr(self, "unseen", np.zeros(size))
                    self.unseen[j] = np.log(d * len(keys) / total / (len(grams) + 1) if len(keys) else 1 / (len(grams) + 1))
                else:
                    total = np.bincount(head_of[at], c, len(heads))
                    kinds = np.bincount(head_of[at], minlength=len(heads))
                    seen = total > 0
                    back[seen, j] = d * kinds[seen] / total[seen]
                    prob[:, j] = back[head_of, j] * below[suffix, j]
                    prob[at, j] += (c - d) / total[head_of[at]]
            self.grams[n], self.logp[n] = grams, np.log(prob).astype(np.float32)
            if n > 1:
                self.heads[n], self.back[n] = heads, np.log(back).astype(np.float32)
            below = prob
        # Of the standard for rejection: mean, variance of all lengths, variance of one character, standard deviations allowed,
        # and the most that is allowed at any length.
        self.standard = np.tile(np.array([0.0, 0.0, 1.0, np.inf, np.inf]), (size, 1))
        self.standard[:, 4] = -self.unseen / 2

    def score(self, keys: np.ndarray) -> np.ndarray:
        """log p of the last character of each 4-gram key given the others, by language."""
        out = np.zeros((len(keys), len(self.languages)), np.float32)
        todo = np.arange(len(keys))
        for n in range(ORDER, 0, -1):
            mine = low(keys[todo], n)
            at = np.minimum(np.searchsorted(self.grams[n], mine), len(self.grams[n]) - 1)
            hit = self.grams[n][at] == mine
            out[todo[hit]] += self.logp[n][at[hit]]
            todo, mine = todo[~hit], mine[~hit]
            if n > 1 and len(todo):
                head = mine >> np.uint64(16)
                at = np.minimum(np.searchsorted(self.heads[n], head), len(self.heads[n]) - 1)
                known = self.heads[n][at] == head
                out[todo[known]] += self.back[n][at[known]]
        out[todo] += self.unseen.astype(np.float32)
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(nats a character by language, letters) of each text; zero letters: no entropy."""
        sym, owner = symbols(texts)
        at = scored(owner)
        owner_at, size = owner[at], len(texts)
        chars = np.bincount(owner_at, minlength=size)
        kinds = np.bincount(owner_at[sym[at] != SPACE], minlength=size)
        sums = np.zeros((size, len(self.languages)))
        if len(at):
            logp = self.score(contexts(sym, owner)[at])
            begin = np.flatnonzero(np.append(True, owner_at[1:] != owner_at[:-1]))
            sums[owner_at[begin]] = np.add.reduceat(logp, begin, axis=0, dtype=np.float64)
        return -sums / np.maximum(1, chars)[:, None], kinds


    def calibrate(self, language: int, nats: np.ndarray, letters: np.ndarray, false_rejection: float) -> None:
        """Set the limit of a language from documents of it."""
        if not len(nats):
            return
        mean, common = nats.mean(), max(nats.var(ddof=min(1, len(nats) - 1)), 1e-4)
        single = mean**2  # the costs of single characters spread about as widely as they are high
        if len(nats) >= FEW:
            square, short = (nats - mean) ** 2, 1 / np.maximum(letters, 1)
            order = np.argsort(short)
            long, brief = order[: (len(order) + 1) // 2], order[len(order) // 2 :]
            gap = short[brief].mean() - short[long].mean()
            single = max(single, (square[brief].mean() - square[long].mean()) / gap) if gap > 0 else single
            common = max(square[long].mean() - single * short[long].mean(), 1e-4)
        away = np.sort((nats - mean) / np.sqrt(common + single / np.maximum(letters, 1)))
        tenth = max(1, len(away) // 10)
        base = away[-tenth - 1] if len(away) > tenth else away[0]
        tail = base + (away[-tenth:] - base).mean() * np.log(max(1.0, tenth / len(away) / false_rejection))
        rank = int(np.ceil((len(away) + 1) * (1 - false_rejection)))
        normal = student_quantile(len(away) - 1, false_rejection) * np.sqrt(1 + 1 / len(away))
        most = max(tail, away[min(rank, len(away)) - 1], normal)
        self.standard[language] = mean, common, single, most, (mean - self.unseen[language]) / 2

    def rejected(self, language: np.ndarray, nats: np.ndarray, letters: np.ndarray) -> np.ndarray:
        mean, common, single, most, highest = self.standard[language].T
        return (letters == 0) | (nats > np.minimum(highest, mean + most * np.sqrt(common + single / np.maximum(letters, 1))))


def char_groups(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    """(first row, last row, texts) of a column, some GROUP bytes at a time; null is empty."""
    for a, b in grouped(byte_sizes(column).tolist(), GROUP):
        yield a, b, [t or "" for t in column.slice(a, b - a).to_pylist()]


def train(
    rows: DataFrame, sample_docs: int = 3000, sample_chars: int = 20_000_000, most_docs: int = 300_000, calibration: float = 1 / 3, false_rejection: float = 1e-4
) -> Models | None:
    """The models from labelled rows (doc_id, text, lang); None if there are none."""
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r for r in rows.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars")).collect()}  # one row a language
    if not sizes:
        return None
    languages = sorted(sizes)
    span = 1 << 30
    pick = F.pmod(F.xxhash64("doc_id", "text", F.lit("sample")), F.lit(span))
    docs = min(sample_docs, -(-most_docs // len(languages)))
    share = lambda r: min(1.0, docs / r.docs, sample_chars / max(1, r.chars))
    limit = F.create_map(*[x for k, r in sizes.items() for x in (F.lit(k), F.lit(int(span * share(r))))])
    sample = rows.where(pick < F.element_at(limit, F.col("lang"))).select("doc_id", "lang", "text").dropDuplicates()  # rows may repeat
    sample = stored(sample, "language-sample")
    held = F.pmod(F.xxhash64("doc_id", "text", F.lit("calibration")), F.lit(1000)) < int(1000 * calibration)

    def count(batches):
        for batch in batches:
            lang = batch.column(0).to_pylist()
            for a, b, texts in char_groups(batch.column(1)):
                sym, owner = symbols(texts)
                at, keys = scored(owner), contexts(sym, owner)
                for name in sorted(set(lang[a:b])):
                    mine = np.array([x == name for x in lang[a:b]])
                    k, c = np.unique(keys[at][mine[owner[at]]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(k)), pa.array(k.view(np.int64)), pa.array(c)], ["lang", "gram", "n"])

    grams = sample.where(~held).select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    grams = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()  # bounded with the sample; columns, no object a row
    counts = [(g["gram"].to_numpy().view(np.uint64), g["n"].to_numpy()) for g in (grams.filter(pc.field("lang") == x) for x in languages)]
    if not any(len(k) for k, _ in counts):
        return None
    models = Models(languages, counts)
    sent = sample.sparkSession.sparkContext.broadcast(models)

    def measured(batches):
        index = {x: i for i, x in enumerate(sent.value.languages)}
        for batch in batches:
            lang = batch.column(0).to_pylist()
            for a, b, texts in char_groups(batch.column(1)):
                nats, kinds = sent.value.entropies(texts)
                own = nats[np.arange(b - a), [index[x] for x in lang[a:b]]]
                yield pa.RecordBatch.from_arrays([pa.array(lang[a:b]), pa.array(own), pa.array(kinds)], ["lang", "nats", "letters"])

    rest = sample.where(held).select("lang", "text").mapInArrow(measured, "lang string, nats double, letters long")
    rest = rest.where("letters > 0").toPandas()  # a row for each calibration document, bounded with the sample
    for i, name in enumerate(languages):
        own = rest[rest.lang == name].sort_values(["letters", "nats"])
        models.calibrate(i, own["nats"].to_numpy(float), own["letters"].to_numpy(float), false_rejection)
    return models


PREDICTED = "doc_id long, lang_pred string, score double, nats double, rejected boolean"


def identify(docs: DataFrame, models: Models | None) -> DataFrame:
    """PREDICTED for each row of docs."""
    names = ["doc_id", "lang_pred", "score", "nats", "rejected"]
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def predict(batches):
        for batch in batches:
            ids = batch.column(0)
            for a, b, texts in char_groups(batch.column(1)):
                n, model = b - a, sent.value
                if model is None:
                    lang, score, best, bad = ["und"] * n, np.zeros(n), np.zeros(n), np.ones(n, bool)
                else:
                    nats, kinds = model.entropies(texts)
                    pick, rows = nats.argmin(1), np.arange(n)
                    best = nats[rows, pick]
                    # The posterior of a text of at most 50 characters; longer ones aren't surer than that here.
                    edge = np.exp((best[:, None] - nats) * np.clip(kinds, 1, 50)[:, None]).sum(1)
                    score = np.where(kinds > 0, 1 / edge, 0.0)
                    lang = [model.languages[p] if k else "und" for p, k in zip(pick, kinds, strict=True)]
                    bad = model.rejected(pick, best, kinds)
                yield pa.RecordBatch.from_arrays([ids.slice(a, n), pa.array(lang, pa.string()), pa.array(score), pa.array(best), pa.array(bad)], names)

    return docs.select("doc_id", "text").mapInArrow(predict, PREDICTED)


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def learned(docs: DataFrame, **options) -> Models | None:
    """Models from the rows of docs that aren't held out."""
    return train(docs.where(~held_out()).select("doc_id", "text", "lang"), **options)


def keep_identified(docs: DataFrame, models: Models | None) -> DataFrame:
    """`docs` without the rows that are rejected; all columns stay."""
    spark, names = docs.sparkSession, docs.columns
    sent = spark.sparkContext.broadcast(models)
    where = names.index("text")

    def keep(batches):
        for batch in batches:
            for a, b, texts in char_groups(batch.column(where)):
                if sent.value is None:
                    continue
                nats, kinds = sent.value.entropies(texts)
                pick = nats.argmin(1)
                good = ~sent.value.rejected(pick, nats[np.arange(b - a), pick], kinds)
                yield batch.slice(a, b - a).filter(pa.array(good))

    return docs.mapInArrow(keep, docs.schema)


def op10_language_id(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs, learned(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
