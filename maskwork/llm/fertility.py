"""Quality rules on tokenizer fertility.

Two public vocabularies measure each text: characters per token under a byte-level one and under one
that falls back to bytes, the share of fallback bytes, and the entropy of the token counts. Each
script has bands for the measures; a text outside a band is rejected, beside the plain rules on length
and repeated words. Each distinct word of a batch is encoded once.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwork.llm.wordcache import WordCache
from maskwork.llm.words import chunks, mix

CHUNK = 1_000_000
LEAST_WORDS = 50
SYMBOLS = "#*$%&|<>"

# Scripts by their first and last code point; a text has the script of most of its letters.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xB5, 0xB5), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "indic": [(0x900, 0xDFF)],
    "thai": [(0xE00, 0xE7F)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
}
# Bands by script: least and most characters per byte-level token, the same per fallback token, most
# share of fallback bytes, least entropy as a share of its largest value for that many tokens.
BANDS = {
    "latin": (1.50, 8.0, 1.70, 8.0, 0.10, 0.40),
    "greek": (0.5, 4.0, 0.7, 4.0, 0.30, 0.35),
    "cyrillic": (0.5, 6.0, 1.0, 6.0, 0.20, 0.35),
    "hebrew": (0.4, 3.0, 0.6, 3.0, 0.40, 0.30),
    "arabic": (0.4, 3.0, 0.6, 3.0, 0.40, 0.30),
    "indic": (0.2, 3.0, 0.2, 3.0, 0.95, 0.15),
    "thai": (0.2, 3.0, 0.2, 3.0, 0.95, 0.15),
    "hangul": (0.3, 3.0, 0.3, 3.0, 0.95, 0.15),
    "kana": (0.3, 3.0, 0.3, 3.0, 0.80, 0.15),
    "han": (0.3, 3.0, 0.3, 3.0, 0.80, 0.15),
    "other": (0.1, 12.0, 0.1, 12.0, 1.00, 0.0),
}
# Languages whose clean text was measured: least characters per fallback token of a long text. A text of n
# words may fall short by WIDEN / sqrt(n), as short texts scatter more.
LANGUAGES = {"en": 2.11, "de": 2.12, "fr": 1.94, "es": 1.89}
WIDEN = 1.0


def _script_table() -> np.ndarray:
    table = np.zeros(0x10000, np.int8)
    for n, spans in enumerate(SCRIPTS.values(), 1):
        for a, b in spans:
            table[a : b + 1] = n
    return table


def _per_text(owner: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(owner, weights, minlength=n)


class Fertility:
    """Measures of texts; the paths are those of the two vocabulary files."""

    def __init__(self, byte_path: str, piece_path: str, pattern: str) -> None:
        import sentencepiece
        import tiktoken

        with open(byte_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        encoding = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        model = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.fallback = np.array([model.is_byte(i) for i in range(model.get_piece_size())])

        def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
            lengths = np.fromiter(map(len, lists), np.int64, len(lists))
            return np.fromiter((i for x in lists for i in x), np.int32, int(lengths.sum())), lengths

        self.pieces = WordCache(lambda words: flat(model.encode(words, num_threads=1)), 400_000)
        self.bytes = WordCache(lambda words: flat([encoding.encode_ordinary(" " + w) for w in words]), 400_000)
        self.scripts = _script_table()

    def measure(self, texts: list) -> dict[str, np.ndarray]:
        words, slots = self.pieces.slots_of(texts)
        byte_words, byte_slots = self.bytes.slots_of(texts)
        n, owner = len(texts), words.owner
        chars = _per_text(owner, n, (words.ends - words.starts).astype(np.float64))
        byte_tokens = _per_text(owner, n, self.bytes.lengths[byte_slots].astype(np.float64))
        lengths = self.pieces.lengths[slots]
        tokens = _per_text(owner, n, lengths.astype(np.float64))
        ends = np.cumsum(lengths)
        inside = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)
        ids = self.pieces.ids[np.repeat(self.pieces.starts[slots], lengths) + inside]
        token_owner = np.repeat(owner, lengths)
        fallback = _per_text(token_owner, n, self.fallback[ids].astype(np.float64))
        kinds, held = np.unique(token_owner << 32 | ids, return_counts=True)
        spread = _per_text(kinds >> 32, n, held * np.log2(held))
        with np.errstate(divide="ignore", invalid="ignore"):
            entropy = np.where(tokens > 0, np.log2(tokens) - spread / tokens, 0.0)
            even = np.where(tokens > 1, entropy / np.log2(tokens), 1.0)
            out = {"chars_per_byte_token": chars / byte_tokens, "chars_per_token": chars / tokens, "byte_share": fallback / tokens}
        out = {k: np.nan_to_num(v) for k, v in out.items()} | {"entropy": entropy, "evenness": even}
        # letters by script
        script = self.scripts[np.minimum(words.code, 0xFFFF)]
        place = np.repeat(np.arange(n), np.diff(words.offsets))[: len(script)]
        counts = np.bincount(place[script > 0] * 16 + script[script > 0], minlength=n * 16).reshape(n, 16)
        out["script"] = np.where(counts.sum(axis=1) > 0, counts.argmax(axis=1), 0)
        # base: words in three-word windows that the text holds twice or more
        h = words.hashes
        repeated = np.zeros(len(h), bool)
        if len(h) > 2:
            grams = mix((h[:-2] * np.uint64(3) + h[1:-1]) * np.uint64(0xD6E8FEB86659FD93) + h[2:] * np.uint64(0x9E3779B97F4A7C15))
            keys = mix(grams + owner[:-2].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            fits = owner[:-2] == owner[2:]
            _, where, times = np.unique(keys[fits], return_inverse=True, return_counts=True)
            begins = np.flatnonzero(fits)[times[where] > 1]
            for shift in range(3):
                repeated[begins + shift] = True
        out["n_words"] = np.diff(words.bounds)
        out["word_chars"] = chars.astype(np.int64)
        out["n_repeat_words"] = _per_text(owner[repeated], n)
        return out


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line.strip("\x20\x09\x0b\x0c\x0d"):
            n += line in seen
            seen.add(line)
    return n


def _verdict(m: dict[str, np.ndarray], languages: list) -> np.ndarray:
    """Whether the measures lie in the bands of the text's language if it has its own, else of its script."""
    bands = np.array([BANDS["other"], *[BANDS[s] for s in SCRIPTS]])[m["script"]].T
    least_b, most_b, least_p, most_p, most_bytes, least_even = bands
    own = np.array([LANGUAGES.get(name, 0.0) for name in languages])
    own = np.where(m["script"] == 1, own - WIDEN / np.sqrt(np.maximum(m["n_words"], 1)), 0.0)
    least_p = np.maximum(least_p, own)
    return ((m["chars_per_byte_token"] >= least_b) & (m["chars_per_byte_token"] <= most_b) & (m["chars_per_token"] >= least_p)
            & (m["chars_per_token"] <= most_p) & (m["byte_share"] <= most_bytes) & (m["evenness"] >= least_even))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = ("chars_per_byte_token", "chars_per_token", "byte_share", "entropy")


def quality_rules(documents: DataFrame, byte_path: str, piece_path: str, pattern: str) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, kept, script and the measures.

    Bands go by the column ``lang`` where it names a measured language, else by script.
    Null and empty texts have no words and fail the base. Repeated rows get equal rows, null ids stay,
    other columns are ignored. Nothing is moved between rows.
    """

    def run(batches):
        fertility = Fertility(byte_path, piece_path, pattern)
        names = np.array(["other", *SCRIPTS])
        for batch in batches:
            docs, texts, languages = batch.column("doc_id"), batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for a, b in chunks(texts, CHUNK):
                part = [t or "" for t in texts[a:b]]
                m = fertility.measure(part)
                m["n_symbols"] = np.array([sum(map(t.count, SYMBOLS)) for t in part])
                m["n_dup_lines"] = np.array([repeated_lines(t) for t in part])
                failed = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
                columns = [docs.slice(a, b - a), *[pa.array(m[c].astype(np.int64)) for c in COUNTS], pa.array(failed),
                           pa.array(~failed & _verdict(m, languages[a:b])), pa.array(names[m["script"]]), *[pa.array(m[c]) for c in MEASURES]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *COUNTS, "base_failed", "kept", "script", *MEASURES])

    lang = F.col("lang").cast("string") if "lang" in documents.columns else F.lit(None).cast("string")
    narrow = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), lang.alias("lang"))
    return narrow.mapInArrow(run, ", ".join([
        "doc_id bigint", *[f"{c} bigint" for c in COUNTS], "base_failed boolean", "kept boolean", "script string",
        *[f"{c} double" for c in MEASURES]]))
