"""Language identification by unigrams of vocabulary pieces, summed over all segmentations."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..staging import stage
from .names import free_name

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Runs of letters and of such numerals as are no digits; ``letters`` takes the latter out.
RUNS = re.compile(r"[^\W\d_]+")
#: Stands before a word, as in the vocabulary.
EDGE = "▁"
#: Words whose scores a Python worker keeps.
MEMORY = 100_000
#: Parts in which a language's rows are cut down to the sample before they meet.
SPREAD = 32
#: Rows that are handed on at once, and new words that are scored at once (one text's may be more).
ROWS, NEW = 512, 20_000
#: Words that are scored at once, and the letters up to which words of one length are; longer ones are scored one by one, in bounded memory.
BLOCK, SIDE_BY_SIDE = 8192, 64
#: Steps after which sums are divided by the last. In as many and a longest piece (16 letters in the default vocabulary) more, sums fall to
#: 1e-224 at least at a floor of 1e-7 (float64: 1e-308).
RESCALE = 16


def letters(text: str) -> list[str]:
    """The words of a text: its runs of letters (Unicode categories L), lower-cased."""
    found = RUNS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split()]


def read_pieces(path: str) -> list[str]:
    """The pieces of a public SentencePiece vocabulary that are letters, after an optional word edge. Read on the driver only."""
    import sentencepiece

    read = sentencepiece.SentencePieceProcessor(model_file=path)
    named = (read.id_to_piece(i).lower() for i in range(read.get_piece_size()))
    return sorted({p for p in named if (p.removeprefix(EDGE) or "a").isalpha()} | {EDGE})


class Lookup:
    """Numbers of pieces by 64-bit hashes of their code points, for whole arrays: two tables, a piece's place in one of which is its own."""

    BITS, STEP = 16, np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, index: dict[str, int]):
        self.bits = max(self.BITS, len(index).bit_length() + 1)
        self.keys, self.values = np.zeros((2, 1 << self.bits), np.uint64), np.full((2, 1 << self.bits), -1, np.int32)
        self.longest = max(map(len, index), default=1)
        sizes: dict[int, list[str]] = {}
        for piece in index:
            sizes.setdefault(len(piece), []).append(piece)
        for own in sizes.values():
            codes = code_points(own)
            h = np.zeros(len(own), np.uint64)
            for k in range(codes.shape[1]):
                h = self.extend(h, codes[:, k])
            places = [self.places(h, side).tolist() for side in (0, 1)]
            for piece, key, first, second in zip(own, h.tolist(), *places, strict=True):
                self._put(key, index[piece], first, second)

    def extend(self, h: np.ndarray, code: np.ndarray) -> np.ndarray:
        return (h ^ (h >> np.uint64(29))) * self.STEP + code

    def places(self, h: np.ndarray, side: int) -> np.ndarray:
        return ((h * np.uint64((0xD6E8FEB86659FD93, 0xA0761D6478BD642F)[side])) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _put(self, key: int, value: int, first: int, second: int) -> None:
        at, side = (first, second), 0
        for _ in range(500):  # what is in the way moves to its place in the other table
            old, out = int(self.values[side, at[side]]), int(self.keys[side, at[side]])
            self.keys[side, at[side]], self.values[side, at[side]] = key, value
            if old < 0:
                return
            key, value, side = out, old, 1 - side
            moved = np.array([key], np.uint64)
            at = (int(self.places(moved, 0)[0]), int(self.places(moved, 1)[0]))
        raise ValueError("the vocabulary does not fit its tables")

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of the piece of each hash, -1 if none has it."""
        first, second = self.places(h, 0), self.places(h, 1)
        other = np.where(self.keys[1][second] == h, self.values[1][second], np.int32(-1))
        return np.where((self.keys[0][first] == h) & (self.values[0][first] >= 0), self.values[0][first], other)


def code_points(words: list[str]) -> np.ndarray:
    """words x letters, for words of one length."""
    n = len(words[0])
    return np.array(words, dtype=f"<U{n}").view(np.uint32).reshape(len(words), n).astype(np.uint64)


@dataclass
class LanguageModel:
    """langs; pieces with a row of ``odds`` (pieces x langs) each; the odds of a character that is no piece; log priors of none."""

    langs: list[str]
    index: dict[str, int]
    odds: np.ndarray
    floor: float

    def __post_init__(self):
        self.lookup = Lookup(self.index)
        self.longest = self.lookup.longest
        self.padded = np.vstack([self.odds, np.zeros((1, self.odds.shape[1]))])

    def word_scores(self, words: list[str]) -> np.ndarray:
        """log of the summed odds of all segmentations (words x langs), by the forward algorithm; short words of one length a step at a time."""
        out = np.empty((len(words), len(self.langs)))
        for at, grid in _by_length(words, self.lookup):
            total, log = _forward(grid, self.padded, self.floor, self.longest)[-1]
            out[at] = np.log(total) + log
        for i, w in enumerate(words):
            if len(w) > SIDE_BY_SIDE:
                out[i] = self._long_score(EDGE + w)
        return out

    def _long_score(self, edged: str) -> np.ndarray:
        """The same for one word, with no more sums in memory than a longest piece has places."""
        get, longest = self.index.get, self.longest
        near, log = [np.ones(len(self.langs))], np.zeros(len(self.langs))
        for e in range(1, len(edged) + 1):
            total = near[-1] * self.floor
            for back in range(1, min(longest, e) + 1):
                if (k := get(edged[e - back : e])) is not None:
                    total = total + near[-back] * self.odds[k]
            near.append(total)
            if len(near) > longest:
                del near[0]
            if e % RESCALE == 0:
                log += np.log(total)
                near = [x / total for x in near]
        return np.log(near[-1]) + log


Grid = dict[tuple[int, int], np.ndarray]


def _by_length(words: list[str], lookup: Lookup, most: int | None = SIDE_BY_SIDE) -> Iterator[tuple[np.ndarray, Grid]]:
    """For words of one length up to ``most``, the piece number (-1: none) at each (from, to) of the edged word, where any word has one."""
    sizes: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        if most is None or len(w) <= most:
            sizes.setdefault(len(w), []).append(i)
    for n, at in sizes.items():
        for a in range(0, len(at), BLOCK):
            part = at[a : a + BLOCK]
            codes = code_points([EDGE + words[i] for i in part])
            grid = {}
            for s in range(n + 1):
                h = np.zeros(len(part), np.uint64)
                for e in range(s + 1, min(n + 1, s + lookup.longest) + 1):
                    h = lookup.extend(h, codes[:, e - 1])
                    ids = lookup.find(h)
                    if ids.max() >= 0:
                        grid[s, e] = ids
            grid.setdefault((n, n + 1), np.full(len(part), -1, np.int32))
            yield np.array(part), grid


def _forward(grid: Grid, padded: np.ndarray, floor: float, longest: int) -> list[tuple[np.ndarray, np.ndarray | float]]:
    """For each place, the sum up to it and the log of what that was divided by (see RESCALE). ``padded`` has a last row of no odds."""
    end = max(e for _, e in grid)
    rows = len(next(iter(grid.values())))
    near, log = [np.ones((rows, padded.shape[1]))], 0.0
    out = [(near[0], log)]
    for e in range(1, end + 1):
        total = near[e - 1] * floor
        for s in range(max(0, e - longest), e):
            if (ids := grid.get((s, e))) is not None:
                total = total + near[s] * padded[ids]
        near.append(total)
        out.append((total, log))
        if e % RESCALE == 0:
            log = log + np.log(total)
            for s in range(max(0, e + 1 - longest), e + 1):
                near[s] = near[s] / total
    return out


def _backward(grid: Grid, padded: np.ndarray, floor: float, longest: int) -> list[tuple[np.ndarray, np.ndarray | float]]:
    """For each place, the sum from it on and the log of what that was divided by (see RESCALE)."""
    end = max(e for _, e in grid)
    rows = len(next(iter(grid.values())))
    near, log = [np.ones((rows, padded.shape[1]))] * (end + 1), 0.0
    out = [(near[end], log)] * (end + 1)
    for s in range(end - 1, -1, -1):
        total = near[s + 1] * floor
        for e in range(s + 1, min(end, s + longest) + 1):
            if (ids := grid.get((s, e))) is not None:
                total = total + padded[ids] * near[e]
        near[s], out[s] = total, (total, log)
        if (end - s) % RESCALE == 0:
            log = log + np.log(total)
            for e in range(s, min(end + 1, s + longest)):
                near[e] = near[e] / total
    return out


def _logs(sums: list[tuple[np.ndarray, np.ndarray | float]]) -> list[np.ndarray]:
    return [np.log(total) + log for total, log in sums]


def _blocks(words: list[str]) -> Iterator[list[int]]:
    """Numbers of words in blocks: short ones together, each long one by itself."""
    short = [i for i, w in enumerate(words) if len(w) <= SIDE_BY_SIDE]
    for a in range(0, len(short), BLOCK):
        yield short[a : a + BLOCK]
    yield from ([i] for i, w in enumerate(words) if len(w) > SIDE_BY_SIDE)


def expected_counts(words: list[str], times: np.ndarray, lookup: Lookup, own: np.ndarray, floor: float) -> np.ndarray:
    """How often each piece is expected in the words' segmentations, under the odds ``own`` (one language's)."""
    longest, n = lookup.longest, len(own)
    padded = np.append(own, 0.0)[:, None]
    seen = np.zeros(n + 1)
    for block in _blocks(words):
        for at, grid in _by_length([words[i] for i in block], lookup, None):
            ahead, back = _logs(_forward(grid, padded, floor, longest)), _logs(_backward(grid, padded, floor, longest))
            for (s, e), ids in grid.items():
                rest = np.exp(ahead[s][:, 0] + back[e][:, 0] - ahead[-1][:, 0])
                seen += np.bincount(ids % (n + 1), weights=times[np.array(block)[at]] * rest * padded[ids, 0], minlength=n + 1)
    return seen[:-1]


def _expect(index: dict[str, int], odds: dict[str, np.ndarray], floor: float):
    """The expected counts of a task's rows (lang, word, count), as lang, piece, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        lookup = Lookup(index)
        for batch in batches:
            own: dict[str, tuple[list[str], list[int]]] = {}
            for lang, word, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words, times = own.setdefault(lang, ([], []))
                words.append(word)
                times.append(n)
            for lang, (words, times) in own.items():
                found = expected_counts(words, np.array(times, float), lookup, odds[lang], floor)
                sums[lang] = sums[lang] + found if lang in sums else found
        for lang, found in sums.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(found[at], pa.float64())], ["lang", "piece", "n"])

    return run


def estimate(counts: DataFrame, pieces: list[str], rounds: int = 2, floor: float = 1e-7) -> LanguageModel:
    """Piece odds of each language by expectation maximisation over word counts (lang, word, count), from even odds.

    Tasks expect the pieces of their own words; no more than a number for each piece and language goes to the driver.
    """
    langs, index = sorted(r.lang for r in counts.select("lang").distinct().collect()), {p: i for i, p in enumerate(pieces)}
    odds = {lang: np.full(len(pieces), 1.0 / max(1, len(pieces))) for lang in langs}
    for _ in range(rounds if langs else 0):
        sums = counts.select("lang", "word", "count").mapInArrow(_expect(index, odds, floor), "lang string, piece long, n double")
        seen = {lang: np.zeros(len(pieces)) for lang in langs}
        for lang, piece, n in sums.groupBy("lang", "piece").agg(F.sum("n")).toLocalIterator():
            seen[lang][piece] = n
        odds = {lang: (x + 0.01) / (x.sum() + 0.01 * len(pieces)) for lang, x in seen.items()}
    table = np.stack([odds[lang] for lang in langs], axis=1) if langs else np.zeros((len(pieces), 0))
    return LanguageModel(langs, index, table, floor)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, word, n of each batch of lang, text."""
    for batch in batches:
        found: Counter[tuple[str, str]] = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found.update((lang, w) for w in letters(text))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.string()), pa.array(found.values(), pa.int64())], ["lang", "word", "n"]
        )


def fit_languages(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", vocabulary: str = VOCABULARY, sample: int = 400) -> LanguageModel:
    """Learn from labelled rows: at most ``sample`` different texts of each language, the first by a hash of the text, whole, and all of
    their words. Rows with a null text or language are not used; repeated rows count once. Nothing labelled gives a model of no language.
    """
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    hashed = rows.select("lang", F.xxhash64("text", F.lit(3)).alias("h")).distinct()
    for parts in (["lang", F.pmod("h", F.lit(SPREAD))], ["lang"]):  # a language of most rows is first cut down in parts
        place = F.row_number().over(W.partitionBy(*parts).orderBy("h"))
        hashed = hashed.withColumn("n", place).where(F.col("n") <= sample).select("lang", "h")
    first = hashed
    chosen = rows.withColumn("h", F.xxhash64("text", F.lit(3))).join(F.broadcast(first), ["lang", "h"]).dropDuplicates(["lang", "h"])
    words = chosen.select("lang", "text").mapInArrow(_counted, "lang string, word string, n long")
    return estimate(stage(words.groupBy("lang", "word").agg(F.sum("n").alias("count")), "words"), read_pieces(vocabulary))


def _predict(model: LanguageModel, text_col: str, hide: bool, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[str, int] = {}
        table = np.zeros((1024, len(model.langs)))
        for batch in (whole.slice(a, ROWS) for whole in batches for a in range(0, max(1, whole.num_rows), ROWS)):
            column = batch.column(batch.schema.get_field_index(text_col))
            langs: list[str] = []
            odds: list[float] = []
            fits: list[float] = []
            waiting: list[Counter[str]] = []
            new: dict[str, None] = {}

            def score() -> None:
                nonlocal table
                if index and len(index) + len(new) > MEMORY:
                    index.clear()
                    new.update(dict.fromkeys(w for c in waiting for w in c))
                if new:
                    at = len(index)
                    if at + len(new) > len(table):
                        table = np.resize(table, (max(2 * len(table), at + len(new)), table.shape[1]))
                    table[at : at + len(new)] = model.word_scores(list(new))
                    index.update(zip(new, range(at, at + len(new)), strict=True))
                for found in waiting:
                    if not found or not model.langs:
                        langs.append("und")
                        odds.append(0.0)
                        fits.append(0.0)
                        continue
                    n = np.fromiter(found.values(), float, len(found))
                    total = n @ table[np.fromiter(map(index.__getitem__, found), np.int64, len(found))]
                    best = int(total.argmax())
                    langs.append(model.langs[best])
                    odds.append(float(1 / np.exp(total - total[best]).sum()))
                    fits.append(float(total[best] / max(1.0, n @ np.fromiter(map(len, found), float, len(found)))))
                waiting.clear()
                new.clear()

            for text in column:
                said = text.as_py()
                waiting.append(Counter(letters(said)) if said else Counter())
                new.update(dict.fromkeys(w for w in waiting[-1] if w not in index))
                if len(new) >= NEW:
                    score()
            score()
            made = [pa.array(langs, pa.string()), pa.array(odds, pa.float64()), pa.array(fits, pa.float64())]
            kept = [i for i, name in enumerate(batch.schema.names) if not (hide and name == text_col)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *made], [*(batch.schema.names[i] for i in kept), *names])

    return run


def identify(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """The columns ``keep`` and lang_pred, score (its odds among the learned languages, 0 to 1) and fit (log odds a letter) of each row.

    A text's words are its runs of letters, lower-cased; a word's odds in a language are the sum over all its segmentations into
    pieces, however long it is, and a text's the product of its words'. ``und`` with score 0 is for texts that are null or hold no letter,
    and for all if nothing was learned. Whole texts are read; a worker keeps the scores of 100,000 words, or of one text's. Ties go to the
    first language by name. ``prefix`` goes before the new names, where the kept columns have these. Repeated rows get the same. An empty
    table gives an empty result.
    """
    hide = text_col not in keep
    rows = docs.select(*keep, text_col) if hide else docs.select(*keep)
    fields = [f"`{x.name}` {x.dataType.simpleString()}" for x in docs.select(*keep).schema]
    names = [prefix + x for x in ("lang_pred", "score", "fit")]
    fields += [f"`{n}` {t}" for n, t in zip(names, ("string", "double", "double"), strict=True)]
    return rows.mapInArrow(_predict(model, text_col, hide, names), ", ".join(fields))


def keep_identified(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", least: float = 0.3, least_fit: float = -8.0) -> DataFrame:
    """The documents of a known language: not ``und``, with a score of ``least`` or more and a fit of ``least_fit`` or more.

    A letter that no piece has costs 16, so a text of which half the letters are of a script that was not learned goes. Columns stay as
    they are, whatever their names.
    """
    prefix = free_name(docs.columns, "_id_")
    found = identify(docs, model, text_col=text_col, keep=tuple(docs.columns), prefix=prefix)
    return found.where((F.col(prefix + "lang_pred") != "und") & (F.col(prefix + "score") >= least) & (F.col(prefix + "fit") >= least_fit)).select(*docs.columns)
