"""Quality rules on words, and the fertility of a public vocabulary on them.

Counts of words, symbols, repeated lines and repeated windows give the base rules. A public vocabulary
measures characters per token, the share of byte-fallback tokens and the entropy of the tokens; medians over
all texts of a language (of a script where the language is null) set the bands outside which a text of some
length is rejected. The bands of a group are drawn towards those of its script, these towards those of all texts.

Nulls and odd rows: a null or empty text has no words and fails the base rule; a null language is judged by
its script; repeated rows count each time and get the same answer; a null id is kept; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from paperloom.llm.words import mix, split_words, text_slices, windows, word_hashes
from paperloom.staging import stage

WINDOW = 8
#: Medians are of texts with so many tokens. A group's median weighs as much as its texts, that of the wider group as so many.
LEAST_TOKENS, PRIOR_TEXTS = 64, 50
#: Groups whose medians travel to the texts (some 5 MB); parts of a group where there are more.
FEW_GROUPS, SALTS = 50_000, 16
MEASURED = ("chars_per_token", "byte_share", "token_entropy")
#: Texts with fewer words fail the base rule.
LEAST_WORDS = 20
#: Characters per token: times and share of the median; byte share: above the median; entropy: share of it.
LONG, SHORT, BYTES, POOR = 2.5, 0.4, 0.25, 0.35
KEPT_WORDS, KEPT_BYTES = 400_000, 48

_symbol = np.zeros(256, bool)
_symbol[list(b"#*$%&|<>")] = True

MEASURES = "doc_id long, grp string, script string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, token_entropy double"


class WordTokens:
    """Token ids of white-space separated words; a worker process keeps what it has encoded."""

    _kept: dict[bytes, bytes] = {}
    _of = None

    def __init__(self, model: bytes):
        import sentencepiece

        if WordTokens._of is None or WordTokens._of[0] != model:
            processor = sentencepiece.SentencePieceProcessor(model_proto=model)
            fallback = np.array([processor.is_byte(i) for i in range(processor.get_piece_size())])
            WordTokens._kept, WordTokens._of = {}, (model, processor, fallback)
        _, self.processor, self.fallback = WordTokens._of

    def __call__(self, words: list[bytes]) -> np.ndarray:
        kept, extra = WordTokens._kept, {}
        fresh = [w for w in set(words) if w not in kept]
        if fresh:
            if len(kept) + len(fresh) > KEPT_WORDS:
                kept.clear()
                fresh = list(set(words))
            for word, ids in zip(fresh, self.processor.encode([w.decode() for w in fresh], num_threads=1), strict=True):
                (kept if len(word) <= KEPT_BYTES and len(kept) < KEPT_WORDS else extra)[word] = np.array(ids, np.int32).tobytes()
        return np.frombuffer(b"".join([kept[w] if w in kept else extra[w] for w in words] if extra else map(kept.__getitem__, words)), np.int32)


def repeat_words(hashes: np.ndarray, first: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Words of each text inside windows that the text holds twice or more."""
    n_words = np.diff(first)
    owner = np.repeat(np.arange(len(n_words)), n_words)
    found = windows(hashes, width)
    at = np.flatnonzero(np.arange(len(found)) + width <= first[owner[: len(found)] + 1])
    if not len(at):
        return np.zeros(len(n_words), np.int64)
    with np.errstate(over="ignore"):
        key = mix(found[at] + (owner[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(at) + 1, bool)
    twice[1:-1] |= same
    twice[:-2] |= same
    starts = at[order[twice[:-1]]]
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge)[:-1] > 0)])
    return covered[first[1:]] - covered[first[:-1]]


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[offsets[1:]] - total[offsets[:-1]]


#: First code point and name of Unicode ranges of scripts; each reaches to the next. Han stands with kana.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "syriac"), (0x0750, "arabic"),
    (0x0780, "thaana"), (0x07C0, "nko"), (0x0800, "other"), (0x0860, "syriac"), (0x0870, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"),
    (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
    (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "cherokee"), (0x1400, "canadian"), (0x1680, "other"), (0x1780, "khmer"),
    (0x1800, "mongolian"), (0x18B0, "canadian"), (0x1900, "other"), (0x1C80, "cyrillic"), (0x1C90, "georgian"), (0x1CC0, "other"), (0x1D00, "latin"), (0x1F00, "greek"), (0x2000, "none"),
    (0x2C60, "latin"), (0x2C80, "other"), (0x2D00, "georgian"), (0x2D30, "other"), (0x2D80, "ethiopic"), (0x2DE0, "cyrillic"), (0x2E00, "none"), (0x2E80, "han"), (0x3000, "none"), (0x3040, "han"),
    (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAA60, "myanmar"), (0xAA80, "other"),
    (0xAB30, "latin"), (0xAB70, "cherokee"), (0xABC0, "other"), (0xAC00, "hangul"), (0xD800, "none"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "none"),
    (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "han"), (0xFFE0, "none"), (0x10000, "other"), (0x1F000, "none"), (0x20000, "han"), (0xE0000, "none"),
)
_FIRST = np.array([first for first, _ in SCRIPTS])
_NAMES = sorted({name for _, name in SCRIPTS})
_PLACE = np.array([_NAMES.index(name) for _, name in SCRIPTS])
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def script_of(text: bytes) -> str:
    """The Unicode script of most letters outside ASCII, or Latin where ASCII letters are more; ties go to the first name."""
    raw = np.frombuffer(text, np.uint8)
    shares = np.zeros(len(_NAMES), np.int64)
    if len(raw) and raw.max() >= 0x80:
        codes = np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)
        codes = codes[codes >= 0xC0]
        shares += np.bincount(_PLACE[np.searchsorted(_FIRST, codes, side="right") - 1], minlength=len(_NAMES))
    shares[_NAMES.index("none")] = 0
    shares[_NAMES.index("latin")] += int(_LETTER[raw].sum())
    return "script:" + _NAMES[int(shares.argmax())] if shares.any() else "script:none"


def measure(docs: DataFrame, model: bytes) -> DataFrame:
    """One row of measures for each text; ``model`` is a SentencePiece model file."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        tokens = WordTokens(shared.value)
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for first, last, data, offsets in text_slices(batch.column("text")):
                starts, ends, of = split_words(data, offsets)
                hashes = word_hashes(data, starts, ends)
                inner = (data & 0xC0) != 0x80
                inner &= ~np.isin(data, np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
                raw = data.tobytes()
                groups, scripts, lines, measured = [], [], [], []
                chars = _sums(inner, offsets)
                for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                    own = raw[a:b]
                    worded = [x for x in own.split(b"\n") if x.strip()]
                    lines.append(len(worded) - len(set(worded)))
                    ids = tokens(own.split())
                    scripts.append(script_of(own))
                    groups.append(langs[first + i] or scripts[-1])
                    if len(ids):
                        counts = np.unique(ids, return_counts=True)[1] / len(ids)
                        measured.append((len(ids), chars[i] / len(ids), float(tokens.fallback[ids].mean()), float(-(counts * np.log2(counts)).sum())))
                    else:
                        measured.append((0, 0.0, 0.0, 0.0))
                columns = [batch.column("doc_id").slice(first, last - first), pa.array(groups, pa.string()), pa.array(scripts, pa.string())]
                columns += [pa.array(x, pa.int64()) for x in (np.diff(of), chars, _sums(_symbol[data], offsets), lines, repeat_words(hashes, of), [m[0] for m in measured])]
                columns += [pa.array([float(m[i]) for m in measured], pa.float64()) for i in (1, 2, 3)]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in MEASURES.split(", ")])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return picked.mapInArrow(run, MEASURES)


def medians(measures: DataFrame, level: str) -> DataFrame:
    """``level, texts`` and the medians of a group's long texts."""
    long = measures.where(F.col("n_tokens") >= LEAST_TOKENS)
    return long.groupBy(level).agg(F.count("*").alias(f"{level}_texts"), *[F.percentile_approx(c, 0.5, 1000).alias(f"{level}_{c}") for c in MEASURED])


def _met(measures: DataFrame, small: DataFrame, level: str) -> DataFrame:
    """``measures`` with the row of its group. Few groups travel to the texts; many meet them by a key that spreads large ones."""
    if small.count() <= FEW_GROUPS:
        return measures.join(F.broadcast(small), level, "left")
    salted = small.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = measures.withColumn("salt_", F.pmod(F.xxhash64("doc_id", "n_tokens", "word_chars"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, [level, "salt_"], "left").drop("salt_")


def judge(measures: DataFrame) -> DataFrame:
    """``measures`` with base_failed, fertile (inside every band of its group) and kept.

    The middle of a band is the group's median drawn towards that of its script, and this towards that of all texts, with the
    weight of ``PRIOR_TEXTS`` texts: a group of any size is judged by one rule, and the more texts it has, the more by its own.
    """
    measures = stage(measures, "fertility")
    told = (F.col("n_tokens") >= LEAST_TOKENS) | (F.col("n_words") >= LEAST_WORDS)
    groups, scripts = (stage(medians(measures, level), "medians") for level in ("grp", "script"))
    # Where no text is long, the medians of all that are judged.
    over = [F.coalesce(*[F.percentile_approx(F.when(of, F.col(c)), 0.5, 1000) for of in (F.col("n_tokens") >= LEAST_TOKENS, told)]).alias(f"all_{c}") for c in MEASURED]
    judged = _met(_met(measures, groups, "grp"), scripts, "script").crossJoin(F.broadcast(measures.agg(*over)))

    def drawn(level: str, c: str, towards):
        n = F.coalesce(f"{level}_texts", F.lit(0))
        return (n * F.coalesce(f"{level}_{c}", F.lit(0.0)) + PRIOR_TEXTS * towards) / (n + PRIOR_TEXTS)

    mid = {c: drawn("grp", c, drawn("script", c, F.col(f"all_{c}"))) for c in MEASURED}
    inside = (
        F.col("chars_per_token").between(SHORT * mid["chars_per_token"], LONG * mid["chars_per_token"])
        & (F.col("byte_share") <= mid["byte_share"] + BYTES) & (F.col("token_entropy") >= POOR * mid["token_entropy"])
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = judged.withColumn("base_failed", failed).withColumn("fertile", ~told | F.coalesce(inside, F.lit(True)))
    kept = judged.withColumn("kept", ~F.col("base_failed") & F.col("fertile"))
    return kept.select("grp", *[c for c in measures.columns if c not in ("grp", "script")], "base_failed", "fertile", "kept")
