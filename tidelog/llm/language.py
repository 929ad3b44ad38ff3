"""Language ID by unigram pieces with the segmentation summed out.

Every language has a probability for each piece of one fixed public vocabulary.
A *unit*, a run of letters in lower case, can be cut into pieces in many ways;
the forward algorithm sums the product of piece probabilities over all of them.
A text's score for a language is the sum of its units' log probabilities; each
distinct unit is scored once and kept. The probabilities come from expectation
maximisation with the same sums (forward and backward) over the labelled texts.

The model may learn from a sample: about ``fit_docs`` documents a language,
taken by a hash of id and text, whatever the input. Scoring takes whole texts.

Defined cases: a text that is null, empty or without letters is ``und`` with
score 0; a null ``lang`` teaches nothing; with no labelled rows every text is
``und``; equal scores go to the first language in order; repeated rows get a row
each; a null ``doc_id`` is scored, teaches and isn't held out; other columns are
ignored. Only what the model learns from has runs of over 64 bytes cut there.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, encoded, hash_spans, table
from .quality import remainder

#: Longer runs are cut for learning, and scored by steps that keep no more than the longest piece needs.
UNIT_BYTES = 64
#: Units kept by a worker.
CACHE = 500_000
#: Log factor a byte, so that sums over pieces stay within a double's range; taken out again at the end.
TILT = 3.0


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> list[bytes]:
    """The pieces of letters of a sentencepiece file in lower case without the mark of a word's start, and every byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {bytes([b]) for b in range(256)}
    for i in range(model.get_piece_size()):
        text = model.id_to_piece(i).replace("▁", "")
        if text.isalpha() and text == text.lower():
            pieces.add(text.encode())
    return sorted(pieces)


def units(texts, cut: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and text, start and end of each run of letters (ASCII letters and bytes of other characters)."""
    data, bounds = encoded(pc.utf8_lower(texts))
    letter = ((data >= 97) & (data <= 122)) | (data >= 128)
    opens, closes = letter.copy(), letter.copy()
    opens[1:] &= ~letter[:-1]
    closes[:-1] &= ~letter[1:]
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    opens[inner] = letter[inner]
    closes[inner - 1] = letter[inner - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    long = end - start > UNIT_BYTES
    if cut and long.any():
        s = [np.arange(a, b, UNIT_BYTES) for a, b in zip(start[long], end[long])]
        e = [np.minimum(x + UNIT_BYTES, b) for x, b in zip(s, end[long])]
        start, end = np.sort(np.concatenate([start[~long], *s])), np.sort(np.concatenate([end[~long], *e]))
    return data, np.searchsorted(bounds, start, side="right") - 1, start, end


class Lattice:
    """The pieces that end and begin at each byte of units of one length."""

    def __init__(self, pieces: list[bytes]):
        sizes = np.array([len(p) for p in pieces])
        ends = np.cumsum(sizes)
        hashes = hash_spans(np.frombuffer(b"".join(pieces), np.uint8), ends - sizes, ends)
        order = np.argsort(hashes)
        self.hashes, self.ids, self.sizes, self.longest = hashes[order], order, sizes, int(sizes.max())
        self.tilt = np.exp(TILT * sizes)

    def spans(self, data: np.ndarray, start: np.ndarray, size: int):
        """``(begin, end, unit, piece)`` over units that all have ``size`` bytes, with ends ascending."""
        for end in range(1, size + 1):
            for begin in range(max(0, end - self.longest), end):
                h = hash_spans(data, start + begin, start + end)
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                unit = np.flatnonzero(self.hashes[at] == h)
                if len(unit):
                    yield begin, end, unit, self.ids[at[unit]]


def forward(lattice: Lattice, data: np.ndarray, start: np.ndarray, size: np.ndarray, tilted: np.ndarray) -> np.ndarray:
    """Log probability of each unit in each language. ``tilted``: languages x pieces."""
    out = np.zeros((len(start), len(tilted)))
    if len(far := np.flatnonzero(size > UNIT_BYTES)):
        far = far[np.argsort(-size[far], kind="stable")]
        for at in range(0, len(far), 64):
            of = far[at : at + 64]
            out[of] = forward_long(lattice, data, start[of], size[of], tilted)
    for n in np.unique(size[size <= UNIT_BYTES]):
        of = np.flatnonzero(size == n)
        alpha = np.zeros((n + 1, len(of), len(tilted)))
        alpha[0] = 1
        for begin, end, unit, piece in lattice.spans(data, start[of], int(n)):
            alpha[end, unit] += alpha[begin, unit] * tilted[:, piece].T
        out[of] = np.log(np.maximum(alpha[n], 1e-300)) - TILT * n
    return out


def forward_long(lattice: Lattice, data: np.ndarray, start: np.ndarray, size: np.ndarray, tilted: np.ndarray) -> np.ndarray:
    """``forward`` for units of any size, in order of descending size: all go on by a byte at a time, with the sums of the last bytes at hand."""
    lengths, languages, none = np.unique(lattice.sizes), len(tilted), tilted.shape[1]
    weight = np.concatenate([tilted, np.zeros((languages, 1))], 1)  # a piece that isn't there
    ring = np.zeros((lattice.longest + 1, len(start), languages))
    ring[0] = 1
    scale, out, step = np.zeros((len(start), languages)), np.zeros((len(start), languages)), 256
    for low in range(0, int(size[0]), step):
        # The pieces that end at each of the next places.
        ends = np.arange(low + 1, min(low + step, int(size[0])) + 1)
        pieces = np.full((len(ends), len(lengths), len(start)), none, np.int64)
        for k, n in enumerate(lengths):
            at, unit = np.nonzero((ends[:, None] >= n) & (ends[:, None] <= size))
            h = hash_spans(data, start[unit] + ends[at] - n, start[unit] + ends[at])
            place = np.minimum(np.searchsorted(lattice.hashes, h), len(lattice.hashes) - 1)
            hit = lattice.hashes[place] == h
            pieces[at[hit], k, unit[hit]] = lattice.ids[place[hit]]
        for i, end in enumerate(ends.tolist()):
            live = int(np.searchsorted(-size, -end, side="right"))
            before = ring[(end - lengths) % len(ring), :live]
            new = (before * weight[:, pieces[i, :, :live]].transpose(1, 2, 0)).sum(0)
            ring[end % len(ring), :live] = new
            done = live - 1
            while done >= 0 and size[done] == end:
                out[done] = np.log(np.maximum(new[done], 1e-300)) + scale[done] - TILT * end
                done -= 1
            if end % 16 == 0:
                ring[:, :live] /= new
                scale[:live] += np.log(new)
    return out


def expected(lattice: Lattice, data: np.ndarray, start: np.ndarray, size: np.ndarray, weight: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected count of each piece in units with ``weight`` under piece probabilities ``p``."""
    counts, tilted = np.zeros(len(p)), p * lattice.tilt
    for n in np.unique(size):
        of = np.flatnonzero(size == n)
        spans = list(lattice.spans(data, start[of], int(n)))
        alpha, beta = np.zeros((n + 1, len(of))), np.zeros((n + 1, len(of)))
        alpha[0], beta[n] = 1, 1
        for begin, end, unit, piece in spans:
            alpha[end, unit] += alpha[begin, unit] * tilted[piece]
        for begin, end, unit, piece in reversed(spans):
            beta[begin, unit] += beta[end, unit] * tilted[piece]
        scale = weight[of] / np.maximum(alpha[n], 1e-300)
        for begin, end, unit, piece in spans:
            counts += np.bincount(piece, alpha[begin, unit] * tilted[piece] * beta[end, unit] * scale[unit], len(p))
    return counts


class Model(NamedTuple):
    languages: list[str]
    pieces: list[bytes]
    log_p: np.ndarray


def train(counted: dict[str, dict[bytes, int]], pieces: list[bytes], rounds: int = 2) -> Model:
    """From the counts of units by language. Starts from one probability for all pieces, less for longer ones."""
    lattice, languages = Lattice(pieces), sorted(counted)
    prior = np.exp(-1.5 * np.array([len(x) for x in pieces]))
    table_ = np.zeros((len(languages), len(pieces)))
    for k, language in enumerate(languages):
        found = list(counted[language])
        size = np.array([len(u) for u in found], np.int64)
        ends = np.cumsum(size)
        data, weight = np.frombuffer(b"".join(found), np.uint8), np.array([counted[language][u] for u in found], float)
        p = prior / prior.sum()
        for _ in range(rounds):
            c = expected(lattice, data, ends - size, size, weight, p) + 0.05
            p = c / c.sum()
        table_[k] = np.log(p)
    return Model(languages, pieces, table_)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.lattice = model, Lattice(model.pieces)
        self.tilted = np.exp(model.log_p) * self.lattice.tilt
        self.known, self.values = np.zeros(0, np.uint64), np.zeros((0, len(model.languages)))

    def _units(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct units' values, and which of them each unit is."""
        h, first, which = np.unique(hash_spans(data, start, end), return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, h)
        there = np.zeros(len(h), bool)
        there[at < len(self.known)] = self.known[at[at < len(self.known)]] == h[at < len(self.known)]
        out = np.zeros((len(h), len(self.model.languages)))
        out[there] = self.values[at[there]]
        if (new := ~there).any():
            out[new] = forward(self.lattice, data, start[first[new]], (end - start)[first[new]], self.tilted)
            if len(self.known) + new.sum() <= CACHE:
                self.known, self.values = np.insert(self.known, at[new], h[new]), np.insert(self.values, at[new], out[new], axis=0)
        return out, which

    def predict(self, texts) -> tuple[list[str], np.ndarray]:
        data, doc, start, end = units(texts)
        names = ["und"] * len(texts)
        score = np.zeros(len(texts))
        if not self.model.languages:
            return names, score
        total = np.zeros((len(texts), len(self.model.languages)))
        if len(start):
            values, which = self._units(data, start, end)
            for k in range(total.shape[1]):
                total[:, k] = np.bincount(doc, values[which, k], len(texts))
        odds = np.exp(total - total.max(1, keepdims=True))
        best, odds = total.argmax(1), odds / odds.sum(1, keepdims=True)
        # Bytes of other characters count as letters; whether a text has any is asked of the text.
        plain = np.bincount(doc[data[start] < 128], minlength=len(texts)) > 0 if len(start) else np.zeros(len(texts), bool)
        for i in range(len(texts)):
            if plain[i] or any(c.isalpha() for c in texts[i].as_py() or ""):
                names[i], score[i] = self.model.languages[best[i]], odds[i, best[i]]
        return names, score


_scorers: dict[bytes, Scorer] = {}


def fit(docs: DataFrame, vocabulary_path: str | None = None, fit_docs: int = 300) -> Model:
    """From ``doc_id``, ``text`` and ``lang`` of documents, about ``fit_docs`` of each language."""
    known = docs.where(F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    of = 1 << 30
    limits = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, min(of, of * fit_docs // n)))) if sizes else None
    counted: dict[str, dict[bytes, int]] = {k: {} for k in sizes}
    if sizes:
        taken = known.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(of)) < limits[F.col("lang")])

        def run(batch):
            data, doc, start, end = units(batch.column(0), cut=True)
            langs = batch.column(1).to_pylist()
            if len(start):
                yield {"lang": [langs[d] for d in doc], "unit": [data[a:b].tobytes() for a, b in zip(start, end)]}

        rows = arrow_map(taken, ["text", "lang"], "lang string, unit binary", run).groupBy("lang", "unit").agg(F.count(F.lit(1)).alias("n"))
        for r in rows.collect():  # the units of about fit_docs documents a language
            counted[r["lang"]][bytes(r["unit"])] = r["n"]
    return train({k: v for k, v in counted.items() if v}, vocabulary(vocabulary_path or default_vocabulary()))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # pieces x languages numbers, fixed by the vocabulary
    name = np.random.default_rng().bytes(16)

    def run(batch):
        if name not in _scorers:
            _scorers.clear()
            _scorers[name] = Scorer(sent.value)
        langs, score = _scorers[name].predict(batch.column(1))
        yield {"doc_id": batch.column(0), "lang_pred": langs, "score": score}

    return arrow_map(docs, ["doc_id", "text"], "doc_id bigint, lang_pred string, score double", run)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(F.coalesce(remainder(F.col("doc_id"), 3) != 1, F.lit(True))))
    return predict(docs, model).select("doc_id", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
