"""Quality rules from tokeniser fertility.

Public vocabularies measure every text word by word (a word with the space
before it): characters per token and token entropy of a byte-level BPE, and the
share of byte-fallback tokens of a BPE over characters. Text outside the
writing that a vocabulary knows, random strings and ground-through repeats fall
outside the band of their language or script and are rejected. Counts of
words, symbols, repeated lines and repeated three-word windows go with it.

Each distinct word of a slice of text is tokenised once; counts are sums over
numpy arrays. Nothing is shuffled and no corpus statistic is kept: a row's
verdict depends on its own text and language.

Cases: a null or empty text has no words, a fertility of 0 and is rejected. An
unknown or null language takes the band of the text's own script, another
script the band "other". Repeated rows get the same verdict. Input columns with
the name of a result are replaced, all others are kept.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from catalens.llm import words

SYMBOLS = b"#*$%&|<>"
#: Scripts by the first byte of a letter's UTF-8 form: (name, first, last).
SCRIPTS = (
    ("latin", 0x41, 0x5A),
    ("latin", 0x61, 0x7A),
    ("latin", 0xC3, 0xCA),
    ("greek", 0xCD, 0xCF),
    ("cyrillic", 0xD0, 0xD4),
    ("hebrew", 0xD6, 0xD7),
    ("arabic", 0xD8, 0xDB),
    ("indic", 0xE0, 0xE0),
    ("cjk", 0xE3, 0xE9),
    ("hangul", 0xEA, 0xED),
)


@dataclass(frozen=True)
class Band:
    """What a text may measure: characters per token, byte-fallback share, bits of entropy per token."""

    characters: tuple[float, float]
    fallback: float
    entropy: float
    variety: float = 0.0  # entropy as a share of the most that so many tokens can have


#: By language, else by script. The four languages' bands lie just outside what labelled good texts measure.
BANDS = {
    "en": Band((2.0, 7.5), 0.05, 5.3, 0.64),
    "de": Band((2.03, 7.5), 0.05, 5.3, 0.64),
    "es": Band((1.87, 7.5), 0.05, 5.3, 0.64),
    "fr": Band((1.86, 7.5), 0.05, 5.3, 0.64),
    "latin": Band((1.8, 7.5), 0.10, 5.0, 0.62),
    "greek": Band((0.5, 4.0), 0.30, 3.5, 0.5),
    "cyrillic": Band((0.7, 6.0), 0.20, 3.5, 0.5),
    "hebrew": Band((0.5, 4.0), 0.50, 3.5, 0.5),
    "arabic": Band((0.5, 5.0), 0.30, 3.5, 0.5),
    "indic": Band((0.3, 4.0), 0.90, 3.0, 0.4),
    "cjk": Band((0.3, 2.5), 0.60, 3.5, 0.5),
    "hangul": Band((0.3, 2.5), 0.90, 3.0, 0.4),
    "other": Band((0.3, 7.5), 0.50, 3.0, 0.4),
}
_NAMES = list(dict.fromkeys([name for name, _, _ in SCRIPTS])) + ["other"]
_SCRIPT = np.full(256, -1, np.int64)
for _name, _first, _last in SCRIPTS:
    _SCRIPT[_first : _last + 1] = _NAMES.index(_name)
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True

RESULTS = {
    "n_words": T.LongType(),
    "word_chars": T.LongType(),
    "n_symbols": T.LongType(),
    "n_dup_lines": T.LongType(),
    "n_repeat_words": T.LongType(),
    "base_failed": T.BooleanType(),
    "script": T.StringType(),
    "chars_per_token": T.DoubleType(),
    "fallback_share": T.DoubleType(),
    "token_entropy": T.DoubleType(),
    "kept": T.BooleanType(),
}


@cache
def _byte_bpe(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("bands", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@cache
def _pieces(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return model, np.array([model.is_byte(i) for i in range(model.vocab_size())])


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeats(text: words.Texts, hashes: np.ndarray) -> np.ndarray:
    """Words per text that lie in a three-word window found twice or more in the text."""
    owner = text.document_of_word()
    if len(owner) < 3:
        return np.zeros(len(text), np.int64)
    whole = owner[:-2] == owner[2:]
    keys = words.mix(words.grams(hashes, 3) + owner[:-2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[whole]
    _, index, count = np.unique(keys, return_inverse=True, return_counts=True)
    twice = np.zeros(len(whole), bool)
    twice[whole] = count[index] > 1
    covered = np.zeros(len(owner), bool)
    for k in range(3):
        covered[k : k + len(twice)] |= twice
    return _sums(covered, text.first)


def _repeated_lines(document: bytes) -> int:
    seen: set[bytes] = set()
    repeats = 0
    for line in document.split(b"\n"):
        if line.strip(b" \t\n\x0b\x0c\r"):
            repeats += line in seen
            seen.add(line)
    return repeats


def _scripts(text: words.Texts) -> np.ndarray:
    kind = _SCRIPT[text.data]
    at = np.flatnonzero(kind >= 0)
    owner = np.searchsorted(text.offsets, at, "right") - 1
    counts = np.bincount(owner * len(_NAMES) + kind[at], minlength=len(text) * len(_NAMES)).reshape(len(text), -1)
    return np.where(counts.any(1), counts.argmax(1), len(_NAMES) - 1)


def measure(column: pa.Array, bytes_path: str, pattern: str, pieces_path: str) -> dict[str, np.ndarray]:
    """All counts and fertility figures of some texts."""
    text = words.split(column)
    hashes = text.hashes(lower=False)
    _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    distinct = [text.word(i).decode() for i in first.tolist()]
    tokens = _byte_bpe(bytes_path, pattern).encode_ordinary
    coded = [tokens(" " + word) for word in distinct]
    lengths = np.fromiter(map(len, coded), np.int64, len(coded))
    model, is_byte = _pieces(pieces_path)
    pieces = model.encode(distinct, num_threads=1) if distinct else []
    piece_lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    flat = np.fromiter((i for piece in pieces for i in piece), np.int64, int(piece_lengths.sum()))
    bytes_per_word = _sums(is_byte[flat], np.concatenate([[0], np.cumsum(piece_lengths)]))

    n_words, characters = text.counts(), text.characters()
    n_tokens = _sums(lengths[inverse], text.first)
    n_pieces = _sums(piece_lengths[inverse], text.first)
    # Token ids of all words in order, so that a sort by (text, id) counts them.
    starts = np.concatenate([[0], np.cumsum(lengths)])
    ids = np.fromiter((i for code in coded for i in code), np.int64, int(starts[-1]))
    spans = lengths[inverse]
    at = np.arange(int(spans.sum())) - np.repeat(np.cumsum(spans) - spans, spans) + np.repeat(starts[inverse], spans)
    owner = np.repeat(text.document_of_word(), spans)
    keys, count = np.unique(owner << 32 | ids[at], return_counts=True)
    weighted = np.bincount(keys >> 32, count * np.log2(count), minlength=len(text))
    safe = np.maximum(n_tokens, 1)
    return {
        "n_words": n_words,
        "word_chars": characters,
        "n_symbols": _sums(_IS_SYMBOL[text.data], text.offsets),
        "n_dup_lines": np.fromiter((_repeated_lines(text.document(i)) for i in range(len(text))), np.int64, len(text)),
        "n_repeat_words": _repeats(text, hashes),
        "script": _scripts(text),
        "chars_per_token": characters / safe,
        "fallback_share": _sums(bytes_per_word[inverse], text.first) / np.maximum(n_pieces, 1),
        "token_entropy": np.log2(safe) - weighted / safe,
        "n_tokens": n_tokens,
    }


def fertility_rules(docs: DataFrame, bytes_path: str, pattern: str, pieces_path: str, bands: dict[str, Band] = BANDS, min_words: int = 50, max_repeat_percent: int = 50, text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """``docs`` with counts, fertility figures, base_failed and kept.

    ``bands`` maps a language of ``lang_col``, or else a script, to its band.
    """
    names = [c for c in docs.columns if c not in RESULTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, text_col, 4_000_000):
            found = measure(batch.column(text_col), bytes_path, pattern, pieces_path)
            scripts = [_NAMES[i] for i in found["script"].tolist()]
            langs = batch.column(lang_col).to_pylist() if lang_col in names else [None] * len(scripts)
            band = [bands.get(lang, bands.get(script, bands["other"])) for lang, script in zip(langs, scripts)]
            low = np.array([b.characters[0] for b in band])
            high = np.array([b.characters[1] for b in band])
            per, fallback, entropy = found["chars_per_token"], found["fallback_share"], found["token_entropy"]
            inside = (per >= low) & (per <= high) & (fallback <= [b.fallback for b in band])
            inside &= entropy >= np.array([b.entropy for b in band])
            inside &= entropy >= np.array([b.variety for b in band]) * np.log2(np.maximum(np.minimum(found["n_tokens"], 1000), 2))
            failed = (found["n_words"] < min_words) | (100 * found["n_repeat_words"] > max_repeat_percent * found["n_words"])
            found |= {"script": scripts, "base_failed": failed, "kept": inside & ~failed}
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(found[c]) for c in RESULTS)], [*names, *RESULTS])

    schema = T.StructType([*docs.select(names).schema.fields, *(T.StructField(c, kind) for c, kind in RESULTS.items())])
    return docs.select(names).mapInArrow(run, schema)
