"""Quality rules on texts: repetition and length first, then tokeniser fertility.

Public vocabularies tell how far a text is from the writing they were made for:

* characters per token of the byte-level vocabulary (few: signs, codes, mixed-up bytes);
* byte-fallback share: characters the piece vocabulary has no piece for, per character;
* token entropy, relative to the most that as many tokens, up to 1,024, could have; the least that is
  asked for rises with the number of tokens where the band says so.

A text is rejected when a measure lies outside the band of its language or, where the language has
none, of its main script. Bands are fixed parameters: they do not depend on the other documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidspark.llm.common import map_rows, text_of
from vidspark.llm.kernels import Words, chunks, grams
from vidspark.llm.tokens import encoder, once


@dataclass(frozen=True)
class Band:
    """Least and most characters per token, most byte-fallback share, least relative entropy.

    ``entropy`` holds up to ``SHORT_TOKENS`` tokens; by ``ENTROPY_TOKENS`` it has grown by ``rise``.
    """

    low: float
    high: float
    fallback: float
    entropy: float
    rise: float = 0.0


# Wide on purpose: clean writing of any topic must pass. Latin scripts with many accents are split
# more finely by the English-based vocabulary; other scripts more finely still. Their low limits lie
# above 1 / (UTF-8 bytes per letter), what a text has that is spelled byte by byte, and below what
# the vocabulary gives plain sentences; fallback shares lie between those of plain sentences and of
# letters drawn evenly from the script. Scripts that are spelled in bytes have few tokens to vary.
BANDS = {
    "en": Band(1.5, 8.0, 0.05, 0.45, 0.15),
    "de": Band(1.4, 8.0, 0.05, 0.45, 0.15),
    "fr": Band(1.3, 8.0, 0.05, 0.45, 0.15),
    "es": Band(1.4, 8.0, 0.05, 0.45, 0.15),
    "latin": Band(1.2, 8.0, 0.10, 0.45, 0.15),
    # Also any text with a tenth of its letters in the Vietnamese block.
    "vi": Band(0.80, 8.0, 0.10, 0.45, 0.15),
    "cyrillic": Band(0.52, 6.0, 0.10, 0.40),
    "greek": Band(0.52, 5.0, 0.25, 0.40),
    "armenian": Band(0.505, 4.0, 0.25, 0.32),
    "hebrew": Band(0.52, 5.0, 0.30, 0.38),
    "arabic": Band(0.52, 5.0, 0.25, 0.40, 0.05),
    "devanagari": Band(0.40, 4.0, 0.25, 0.33),
    "bengali": Band(0.36, 4.0, 0.30, 0.33),
    "tamil": Band(0.335, 4.0, 0.30, 0.27),
    "thai": Band(0.36, 4.0, 0.25, 0.33),
    "georgian": Band(0.335, 4.0, 0.25, 0.27),
    "kana": Band(0.36, 4.0, 0.35, 0.45, 0.10),
    "hangul": Band(0.36, 4.0, 0.35, 0.40, 0.05),
    "han": Band(0.36, 4.0, 0.35, 0.45, 0.10),
    # Living scripts with few pieces or none.
    "spelled": Band(0.335, 4.0, 0.92, 0.27),
    "other": Band(0.335, 4.0, 0.50, 0.40),
}
# First code points of ranges and their script; "" takes no part: punctuation and marks of any script.
_RANGES = (
    (0x250, "latin"), (0x2B0, ""), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x700, "spelled"),
    (0x750, "arabic"), (0x780, "spelled"), (0x800, "other"), (0x860, "arabic"), (0x900, "devanagari"), (0x980, "bengali"), (0xA00, "spelled"), (0xB80, "tamil"),
    (0xC00, "spelled"), (0xE00, "thai"), (0xE80, "spelled"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "spelled"), (0x1680, "other"),
    (0x1780, "spelled"), (0x18B0, "other"), (0x1C90, "georgian"), (0x1CC0, "other"), (0x1E00, "latin"), (0x1EA0, "vi"), (0x1F00, "greek"), (0x2000, ""), (0x2070, "other"),
    (0x2D30, "spelled"), (0x2E00, ""), (0x2E80, "han"), (0x3000, ""), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0x31F0, "kana"),
    (0x3200, "other"), (0x3400, "han"), (0xA000, "spelled"), (0xA4D0, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA8E0, "devanagari"), (0xA900, "other"),
    (0xAB00, "spelled"), (0xAB30, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0xFB1D, "hebrew"), (0xFB50, "arabic"),
    (0xFE00, ""), (0xFE70, "arabic"), (0xFEFF, ""), (0xFF21, "other"), (0xFF5B, ""), (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han"), (0x32000, "other"),
)
# By rank, the first of which wins ties.
_SCRIPTS = ["latin", "cyrillic", *sorted({s for _, s in _RANGES} - {"", "latin", "cyrillic", "other"}), "other", ""]
_VI = _SCRIPTS.index("vi")
_STARTS = np.array([c for c, _ in _RANGES], np.uint32)
_RANKS = np.array([_SCRIPTS.index(s) for _, s in _RANGES])
SHORT_TOKENS = 128
ENTROPY_TOKENS = 1024
MIN_WORDS = 50
MAX_REPEATED = 50  # percent of words in repeated windows

RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "chars_per_token double, fallback_share double, token_entropy double, kept boolean"
)
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_BLANK = " \t\n\x0b\x0c\r"


class Pieces:
    """Which characters the piece vocabulary can only spell as bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.known: dict[str, bool] = {}

    def fallback(self, letters: str) -> bool:
        have = self.known.get(letters)
        if have is None:
            if len(self.known) > 100_000:
                self.known.clear()
            have = self.known[letters] = self.model.piece_to_id(letters) == self.model.unk_id()
        return have

    def share(self, text: str) -> float:
        if text.isascii() or not text:
            return 0.0
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        code, times = np.unique(code[code >= 128], return_counts=True)
        return float(sum(n for c, n in zip(code, times, strict=True) if self.fallback(chr(c))) / len(text))


def script(text: str) -> str:
    """Main script of a text by its letters: the name of a band."""
    if text.isascii():
        return "latin"
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    latin = np.count_nonzero(((code | 32) >= 97) & ((code | 32) <= 122)) + np.count_nonzero((code >= 0xC0) & (code < 0x250))
    times = np.bincount(_RANKS[np.searchsorted(_STARTS, code[code >= 0x250], "right") - 1], minlength=len(_SCRIPTS))
    marked, times[_VI] = times[_VI], 0
    times[0] += latin + marked
    main = _SCRIPTS[int(np.argmax(times[:-1]))]
    return "vi" if main == "latin" and marked and 10 * marked >= times[0] else main


def base_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, their characters, symbols and words in repeated three-word windows, by text."""
    w = Words(texts)
    n_words = np.diff(w.first)
    letters = np.where(((w.buf & 0xC0) != 0x80) & ~w.space, 1, 0)
    ends = w.doc_at[:-1]
    word_chars = np.add.reduceat(letters, ends)
    symbols = np.add.reduceat(_SYMBOL[w.buf], ends)
    repeated = np.zeros(len(w.start) + 1, np.int64)
    if len(w.start) >= 3:
        doc = np.repeat(np.arange(len(texts)), n_words)
        same = doc[2:] == doc[:-2]
        at = np.flatnonzero(same)
        key = grams(w.hashes(), 3)[at] + doc[at].astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        order = np.argsort(key, kind="stable")
        twin = key[order][1:] == key[order][:-1]
        hit = np.zeros(len(at), bool)
        hit[order[1:][twin]] = True
        hit[order[:-1][twin]] = True
        edges = np.zeros(len(w.start) + 1, np.int64)
        np.add.at(edges, at[hit], 1)
        np.add.at(edges, at[hit] + 3, -1)
        repeated = (np.cumsum(edges) > 0).astype(np.int64)
    total = np.concatenate(([0], np.cumsum(repeated[: len(w.start)])))
    n_repeat = total[w.first[1:]] - total[w.first[:-1]]
    return n_words, word_chars, symbols, n_repeat


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    return len(lines) - len(set(lines))


def entropy(ids: np.ndarray) -> float:
    """Entropy of the ids over the most that so many, up to ``ENTROPY_TOKENS``, can have (one: 1)."""
    if len(ids) < 2:
        return 1.0
    p = np.unique(ids, return_counts=True)[1] / len(ids)
    return float(-(p * np.log(p)).sum() / np.log(min(len(ids), ENTROPY_TOKENS)))


def least_entropy(band: Band, tokens: int) -> float:
    """The entropy a text of so many tokens needs: the rise is even in the logarithm of their number."""
    grown = np.log(max(tokens, 1) / SHORT_TOKENS) / np.log(ENTROPY_TOKENS / SHORT_TOKENS)
    return band.entropy + band.rise * float(min(1.0, max(0.0, grown)))


def measure(docs: DataFrame, byte_vocabulary: str, piece_vocabulary: str, bands: dict[str, Band] | None = None) -> DataFrame:
    """``docs`` with the counts, measures and verdict of ``RESULT`` behind its own columns.

    A map over rows. Null and empty texts have no words and fail the base rules. Columns of
    ``docs`` that clash with a result's name give way to it. Languages without a band, null ones
    included, are judged by script.
    """
    bands = bands or BANDS
    lang = docs["lang"].cast("string") if "lang" in docs.columns else F.lit(None).cast("string")

    def make():
        encode, pieces = encoder(byte_vocabulary), once(Pieces, piece_vocabulary)

        def judge(texts, langs):
            parts = [_judge(texts[at : at + len(g)], langs[at : at + len(g)], g, encode, pieces, bands) for at, g in chunks(texts)]
            return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [[]] * 10

        return judge

    return map_rows(docs, [text_of(docs), lang], make, RESULT)


def _judge(texts: list[str], langs: list[str | None], data: list[bytes], encode, pieces: Pieces, bands: dict[str, Band]) -> list:
    n_words, word_chars, n_symbols, n_repeat = base_counts(data)
    n_lines = np.array([duplicate_lines(t) for t in texts], np.int64)
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEATED * n_words)
    ids = [encode(t) for t in texts]
    per = np.array([len(t) / max(1, len(i)) for t, i in zip(texts, ids, strict=True)])
    share = np.array([pieces.share(t) for t in texts])
    bits = np.array([entropy(i) for i in ids])
    band = [bands.get(x) or bands[script(t)] for x, t in zip(langs, texts, strict=True)]
    low, high, most = (np.array([getattr(b, k) for b in band]) for k in ("low", "high", "fallback"))
    least = np.array([least_entropy(b, len(i)) for b, i in zip(band, ids, strict=True)])
    inside = (per >= low) & (per <= high) & (share <= most) & (bits >= least)
    return [n_words, word_chars, n_symbols, n_lines, n_repeat, failed, per, share, bits, ~failed & inside]


def quality_filter(docs: DataFrame, byte_vocabulary: str, piece_vocabulary: str) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns only, whatever their names.

    Null and empty texts fail; each of several equal rows is judged alike; an empty table stays empty.
    """
    read = {"text": "text", "lang": "lang"}
    names = [read.get(c, f"own{i}") for i, c in enumerate(docs.columns)]
    plain = docs.select(*[docs[f"`{c}`"].alias(n) for c, n in zip(docs.columns, names, strict=True)])
    kept = measure(plain, byte_vocabulary, piece_vocabulary).filter("kept")
    return kept.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])
