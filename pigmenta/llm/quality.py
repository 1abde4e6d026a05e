"""Quality rules: word statistics plus tokeniser fertility with rejection bands.

A public vocabulary measures characters per token, the share of tokens that hold
only part of a character (byte fallback) and the entropy of the tokens, which is
taken over windows of fixed size so that it does not fall with length. Texts
outside the band of their language are rejected. A short text says little, so its figures
are drawn towards the middle of the band as if ``prior_tokens`` ordinary tokens were added;
the same formula holds for texts of any length. Nothing is shuffled: every row is judged
on its own, whole text. The vocabulary is read by the driver and broadcast (its size is checked).

Defined cases: a null text counts as empty; an empty text has no words, fails the
base rule and is not kept; a null or unknown language takes the band of the text's
script, or the default band where the script has none; repeated rows are judged
alike; extra columns are not looked at. Texts of any length are tokenised whole and as they
are: in pieces cut only where a token must end, between a character and white space after it.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .names import column, keep_rows, position
from .textbatch import Words, slices, column_buffer, groups, mix64, rolling

TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: The public pre-token pattern of the rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PIECE = 50_000
#: A place where a token must end, whatever is around it.
_CUT = re.compile(r"(?<=\S)[ \n\t\r]")
#: Runs of white space that the pre-token expression would search too deeply, in its own terms.
_SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")
#: Largest vocabulary file that is broadcast.
MAX_VOCABULARY = 64 << 20


@dataclass(frozen=True)
class Band:
    """Texts outside it are rejected."""

    min_chars_per_token: float = 1.0
    max_chars_per_token: float = 6.5
    max_partial_share: float = 0.30
    min_entropy_share: float = 0.45

    @property
    def middle(self) -> tuple[float, float, float]:
        """What a text of which nothing is known is taken to have."""
        return (self.min_chars_per_token * self.max_chars_per_token) ** 0.5, self.max_partial_share / 2, (1 + self.min_entropy_share) / 2


def _bands() -> dict[str, Band]:
    return {
        "en": Band(2.0, 6.5, 0.05, 0.45),
        "fr": Band(1.95, 6.5, 0.10, 0.45),
        "de": Band(2.0, 6.5, 0.10, 0.45),
        "es": Band(1.85, 6.5, 0.10, 0.45),
    }


#: Blocks of the scripts whose clean text the default band does not fit: first and last code point.
_BLOCKS = sorted([
    (0x0530, 0x058F, "armenian"), (0x0900, 0x097F, "devanagari"), (0x0980, 0x09FF, "bengali"), (0x0A00, 0x0A7F, "gurmukhi"), (0x0A80, 0x0AFF, "gujarati"),
    (0x0B80, 0x0BFF, "tamil"), (0x0C00, 0x0C7F, "telugu"), (0x0C80, 0x0CFF, "kannada"), (0x0D00, 0x0D7F, "malayalam"), (0x0D80, 0x0DFF, "sinhala"),
    (0x0E00, 0x0E7F, "thai"), (0x0E80, 0x0EFF, "lao"), (0x1000, 0x109F, "myanmar"), (0x10A0, 0x10FF, "georgian"), (0x1100, 0x11FF, "hangul"), (0x1200, 0x139F, "ethiopic"),
    (0x1780, 0x17FF, "khmer"), (0x3040, 0x30FF, "han"), (0x3400, 0x4DBF, "han"), (0x4E00, 0x9FFF, "han"), (0xAC00, 0xD7AF, "hangul"), (0xF900, 0xFAFF, "han"), (0x20000, 0x323AF, "han"),
])
_NAMES = sorted({name for _, _, name in _BLOCKS})
_FIRST, _LAST = (np.array([b[i] for b in _BLOCKS], dtype=np.uint32) for i in range(2))
_NAME_OF = np.array([_NAMES.index(name) for _, _, name in _BLOCKS])
#: Letters of all other scripts: Latin, and what lies above its signs but is no punctuation.
_OTHER = [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x1FFF), (0x2C00, 0x2DFF), (0xA000, 0xABFF)]


def _scripts() -> dict[str, Band]:
    """Bands of scripts, measured on clean sentences (those of the tests).

    0.75 of their characters per token, 0.15 more than their share of partial tokens, and
    0.8 of their entropy, in bits, over that of a full window, where the default is stricter.
    """
    return {
        "armenian": Band(0.65, 6.5, 0.89, 0.32), "bengali": Band(0.38, 6.5, 1.0, 0.27), "devanagari": Band(0.67, 6.5, 0.66, 0.31), "ethiopic": Band(0.31, 6.5, 1.0, 0.25),
        "georgian": Band(0.31, 6.5, 1.0, 0.21), "gujarati": Band(0.29, 6.5, 1.0, 0.24), "gurmukhi": Band(0.38, 6.5, 1.0, 0.27), "han": Band(0.67, 6.5, 0.43, 0.42),
        "hangul": Band(0.97, 6.5, 0.58, 0.44), "kannada": Band(0.44, 6.5, 1.0, 0.26), "khmer": Band(0.36, 6.5, 1.0, 0.26), "lao": Band(0.26, 6.5, 1.0, 0.22),
        "malayalam": Band(0.34, 6.5, 1.0, 0.25), "myanmar": Band(0.27, 6.5, 1.0, 0.21), "sinhala": Band(0.43, 6.5, 1.0, 0.27), "tamil": Band(0.89, 6.5, 0.30, 0.30),
        "telugu": Band(0.39, 6.5, 1.0, 0.25), "thai": Band(0.79, 6.5, 0.33, 0.36),
    }


def script_of(text: str) -> str | None:
    """The script of ``_BLOCKS`` that has more letters of the text than any other, and than all others not listed."""
    if text.isascii():
        return None
    listed, others = np.zeros(len(_NAMES), dtype=np.int64), 0
    for at in range(0, len(text), _PIECE):
        codes = np.frombuffer(text[at : at + _PIECE].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        block = np.searchsorted(_FIRST, codes, "right") - 1
        inside = (block >= 0) & (codes <= _LAST[block])
        listed += np.bincount(_NAME_OF[block[inside]], minlength=len(_NAMES))
        rest = codes[~inside]
        others += sum(int(((rest >= a) & (rest <= b)).sum()) for a, b in _OTHER)
    best = int(listed.argmax())
    return _NAMES[best] if listed[best] > others else None


@dataclass(frozen=True)
class QualityRules:
    """Parameters of the rules.

    A text's figures count as much as its tokens, the middle of its band as ``prior_tokens``.

    Entropy is that of windows of ``entropy_window`` tokens: over these, text of the four
    languages that passes the other rules has a share of 0.50 or more, whatever its length.
    """

    bands: dict[str, Band] = field(default_factory=_bands)
    scripts: dict[str, Band] = field(default_factory=_scripts)
    default: Band = Band()
    prior_tokens: int = 48
    entropy_window: int = 4096
    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    tokenizer_dir: str = TOKENIZER_DIR
    vocabulary: str = VOCABULARY


def vocabulary(rules: QualityRules) -> bytes:
    """The rank file of the rules."""
    path = Path(rules.tokenizer_dir, rules.vocabulary)
    if path.stat().st_size > MAX_VOCABULARY:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY} bytes")
    return path.read_bytes()


@lru_cache(maxsize=4)
def _encoder(body: bytes):
    """(tiktoken encoding, per token: True if it holds only a part of a character) of a rank file."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, body.splitlines())}
    partial = np.zeros(max(ranks.values()) + 1, dtype=bool)
    for token, rank in ranks.items():
        try:
            token.decode()
        except UnicodeDecodeError:
            partial[rank] = True
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), partial


def _pieces(text: str) -> Iterator[str]:
    """The text in parts that end where a token must."""
    at = 0
    while len(text) - at > _PIECE and (cut := _CUT.search(text, at + _PIECE)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def _tokens(encoding, piece: str) -> Iterator[np.ndarray]:
    """Token ids of a part. Of a very long run of white space before a character all but the last is one pre-token."""
    at = 0
    for run in _SPACES.finditer(piece):
        end = run.end() if run.end() == len(piece) else run.end() - 1
        yield encoding.encode_to_numpy(piece[at : run.start()], disallowed_special=())
        yield np.array(encoding._core_bpe.encode_single_piece(piece[run.start() : end].encode()), dtype=np.uint32)
        at = end
    yield encoding.encode_to_numpy(piece[at:], disallowed_special=())


def _entropy_shares(windows: np.ndarray) -> np.ndarray:
    """Entropy over its maximum of each row of token ids; rows hold two or more."""
    n_rows, size = windows.shape
    ordered = np.sort(windows, axis=1)
    first = np.ones((n_rows, size), dtype=bool)
    first[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    at = np.flatnonzero(first)
    counts = np.diff(np.append(at, n_rows * size))
    terms = np.bincount(at // size, weights=counts * np.log2(counts), minlength=n_rows)
    return 1.0 - terms / (size * np.log2(size))


def fertility(text: str, rules: QualityRules, body: bytes | None = None) -> tuple[int, float, float, float]:
    """(tokens, characters per token, share of partial-character tokens, entropy over its maximum).

    The entropy of a language levels off while its maximum grows with the text, so it is
    the mean over windows of ``rules.entropy_window`` tokens that cover the whole text. The
    last window reaches back into the one before and weighs as much as its new tokens.
    """
    if not text:
        return 0, 0.0, 0.0, 0.0
    encoding, partial = _encoder(vocabulary(rules) if body is None else body)
    width = rules.entropy_window
    n, n_partial, total = 0, 0, 0.0
    last = rest = np.zeros(0, dtype=np.uint32)
    for ids in (ids for piece in _pieces(text) for ids in _tokens(encoding, piece)):
        n += len(ids)
        n_partial += int(partial[ids].sum())
        rest = np.concatenate([rest, ids])
        if whole := len(rest) // width * width:
            total += width * float(_entropy_shares(rest[:whole].reshape(-1, width)).sum())
            last, rest = rest[whole - width : whole], rest[whole:]
    end = np.concatenate([last, rest])[-width:]
    if len(rest) and len(end) > 1:
        total += len(rest) * float(_entropy_shares(end[None, :])[0])
    return n, len(text) / n, n_partial / n, total / n


def shrunk(n: int, chars: float, partial: float, entropy: float, band: Band, prior: int) -> tuple[float, float, float]:
    """The figures of a text of ``n`` tokens after ``prior`` tokens from the middle of the band are added."""
    middle = band.middle
    per_token = (n * chars + prior * middle[0]) / max(1, n + prior)
    return (per_token, *((n * x + prior * m) / max(1, n + prior) for x, m in ((partial, middle[1]), (entropy, middle[2]))))


def _in_band(n: int, chars: float, partial: float, entropy: float, band: Band, prior: int = 0) -> bool:
    chars, partial, entropy = shrunk(n, chars, partial, entropy, band, prior)
    return band.min_chars_per_token <= chars <= band.max_chars_per_token and partial <= band.max_partial_share and entropy >= band.min_entropy_share


_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offsets])


def _repeat_words(words: Words, k: int) -> np.ndarray:
    """Per row: words inside a window of ``k`` words that the row holds twice or more."""
    n_rows = len(words.offsets) - 1
    at = words.windows(k)
    if not len(at):
        return np.zeros(n_rows, dtype=np.int64)
    own = mix64(words.row[at].astype(np.uint64) + np.uint64(1))
    first, second = words.hashes(0), words.hashes(1)
    key, check = rolling(first, k, 0)[at] ^ own, rolling(second, k, 1)[at]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    same &= (check[order][1:] == check[order][:-1]) & (words.row[at][order][1:] == words.row[at][order][:-1])
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    delta = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(delta, at[twice], 1)
    np.add.at(delta, at[twice] + k, -1)
    covered = np.cumsum(delta[:-1]) > 0
    return _sums(covered, words.bounds)


def _dup_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif line.strip(" \t\n\x0b\x0c\r"):
            seen.add(line)
    return n


def judge(texts: pa.Array, langs: list[str | None], rules: QualityRules, body: bytes | None = None) -> dict[str, list]:
    """Statistics and verdict of each text, by column name."""
    vocabulary_ = vocabulary(rules) if body is None else body
    raw, offsets = column_buffer(texts)
    strings = ["" if t is None else t for t in texts.to_pylist()]
    out: dict[str, list] = {c: [] for c, _ in COLUMNS}
    for low, high in groups(offsets):
        part = offsets[low : high + 1]
        data, off = raw[part[0] : part[-1]], part - part[0]
        words = Words(data, off)
        n_words = words.counts
        symbols = _sums(_SYMBOLS[data], off)
        points = _sums(words.is_word[data] & ((data & 0xC0) != 0x80), off)
        repeats = _repeat_words(words, rules.window)
        for i in range(high - low):
            n, rep = int(n_words[i]), int(repeats[i])
            failed = n < rules.min_words or 100 * rep > rules.max_repeat_percent * n
            text = strings[low + i]
            tokens, chars, partial, entropy = fertility(text, rules, vocabulary_)
            lang = langs[low + i]
            band = rules.bands.get(lang) if isinstance(lang, str) else None
            if band is None:
                band = rules.scripts.get(script_of(text), rules.default)
            good = _in_band(tokens, chars, partial, entropy, band, rules.prior_tokens)
            for name, value in zip(out, (n, int(points[i]), int(symbols[i]), _dup_lines(text), rep, failed, not failed and good, tokens, chars, partial, entropy), strict=True):
                out[name].append(value)
    return out


COLUMNS = [
    ("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("kept", "boolean"),
    ("n_tokens", "long"), ("chars_per_token", "double"), ("partial_share", "double"), ("entropy_share", "double"),
]
_ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}


def quality_report(df: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang", rules: QualityRules | None = None) -> DataFrame:
    """One row per row of ``df``: its id, the word statistics, the fertility figures and ``kept``."""
    rules = rules or QualityRules()
    ranks = df.sparkSession.sparkContext.broadcast(vocabulary(rules))
    narrow = df.select(column(df, id_column).alias("id_"), column(df, text).cast("string").alias("text_"), column(df, lang).cast("string").alias("lang_"))
    ddl = ", ".join([f"id_ {narrow.schema[0].dataType.simpleString()}", *(f"{c} {t}" for c, t in COLUMNS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = judge(batch.column(1), batch.column(2).to_pylist(), rules, ranks.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[c], _ARROW[t]) for c, t in COLUMNS)], names=["id_", *(c for c, _ in COLUMNS)])

    return narrow.mapInArrow(run, ddl).withColumnRenamed("id_", id_column)


def keep_good(df: DataFrame, text: str = "text", lang: str = "lang", rules: QualityRules | None = None) -> DataFrame:
    """The rows of ``df`` that the rules keep, with all their columns."""
    rules = rules or QualityRules()
    ranks = df.sparkSession.sparkContext.broadcast(vocabulary(rules))
    at_text, at_lang = position(df, text), position(df, lang)
    return keep_rows(df, lambda batch: judge(batch.column(at_text), batch.column(at_lang).to_pylist(), rules, ranks.value)["kept"])


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Quality rules over all documents."""
    return quality_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
