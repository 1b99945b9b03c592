"""Language identification by compression against per-language zstandard dictionaries (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cambium.llm.common import batched, held_out

UNKNOWN = "und"


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass(frozen=True)
class LanguageModel:
    """Raw-content dictionaries by language; their size is bounded by languages x `dictionary_bytes` of `fit`."""

    dictionaries: tuple[tuple[str, bytes], ...]
    level: int = 6
    #: Bytes of text compressed at a time, so that a long text can't serve as its own dictionary. All pieces count.
    piece: int = 4096
    #: Weight of a bit of difference in `score`; the sizes of two languages aren't independent evidence.
    sharpness: float = 0.02
    #: A prediction is rejected if the runner-up needs fewer than this many bytes more.
    margin: int = 2

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for _, content in self.dictionaries:
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=self.level)
            out.append(zstandard.ZstdCompressor(dict_data=data, level=self.level, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out

    def predict(self, text: str | None, compressors: list[zstandard.ZstdCompressor]) -> tuple[str, float, int]:
        """Language (ties: the first by name), score, and the bytes that the runner-up needs more."""
        if not text or not compressors or not _has_letter(text):
            return UNKNOWN, 0.0, 0
        raw = text.lower().encode()
        pieces = [raw[i : i + self.piece] for i in range(0, len(raw), self.piece)]
        sizes = np.array([sum(len(c.compress(p)) for p in pieces) for c in compressors], np.float64)
        best = int(sizes.argmin())
        gaps = sizes - sizes[best]
        score = 1.0 / np.exp2(-8 * self.sharpness * gaps).sum()
        return self.dictionaries[best][0], float(score), int(np.delete(gaps, best).min()) if len(gaps) > 1 else self.margin


def fit(docs: DataFrame, dictionary_bytes: int = 64 << 10, sample_docs: int = 160, sample_chars: int = 4096, languages: int = 256) -> LanguageModel:
    """Dictionaries from a bounded sample of labelled rows: `sample_docs` a language, of each a run of `sample_chars` at most.

    Only text and non-null lang are used, of rows that `held_out` doesn't hold out; rows with a null or empty text or
    lang aren't sampled, and equal texts count once. The sample and the place of each run are by hash, so they don't
    depend on the order of rows. Of more than `languages` values of lang, the most frequent ones are learned. Runs of
    another language within the sample are left out, see `cleaned`.
    """
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()}
    if not counts:
        return LanguageModel(())
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, 1.5 * sample_docs / n)))])
    start = F.pmod(F.xxhash64("doc_id", F.lit("run")), F.greatest(F.length("text") - sample_chars + 1, F.lit(1))) + 1
    run = F.col("text").substr(start.cast("int"), F.lit(sample_chars))
    sample = rows.where(draw < F.element_at(share, F.col("lang"))).select("lang", F.xxhash64("doc_id").alias("h"), run.alias("text")).collect()
    texts: dict[str, list[str]] = {lang: [] for lang in sorted(counts)}
    for r in sorted(sample, key=lambda r: (r["lang"], r["h"], r["text"])):
        texts[r["lang"]].append(r["text"].lower())
    return cleaned({lang: list(dict.fromkeys(t))[:sample_docs] for lang, t in texts.items()}, dictionary_bytes)


def _model(lines: dict[str, list[str]], dictionary_bytes: int) -> LanguageModel:
    """Dictionaries of as many whole lines as fit (the first line in part, if it is longer)."""
    packed = []
    for lang, x in sorted(lines.items()):
        sizes = np.cumsum([len(line.encode()) + 1 for line in x])
        packed.append((lang, "\n".join(x[: max(1, int(np.searchsorted(sizes, dictionary_bytes, side="right")))]).encode()[:dictionary_bytes]))
    return LanguageModel(tuple(x for x in packed if len(x[1]) >= 8))


def cleaned(texts: dict[str, list[str]], dictionary_bytes: int, words: int = 16, passes: int = 2) -> LanguageModel:
    """Dictionaries without runs of `words` words that look like another language, such as quotations and licences.

    Each half of a language's texts is judged by dictionaries of the other halves; runs that compress clearly better as
    another language are left out of the dictionaries. The next pass judges by what was left. Lines that the samples of
    two languages share are left out at once. A language of which under 1,024 characters would stay keeps its texts.
    """
    owners: dict[str, set[str]] = {}
    for lang, x in texts.items():
        for line in {line for t in x for line in t.splitlines()}:
            owners.setdefault(line, set()).add(lang)
    own = {lang: [" ".join(line for line in t.splitlines() if len(owners[line]) == 1) for t in x] for lang, x in texts.items()}
    halves = [{lang: [" ".join(w[j : j + words]) for t in x[i::2] if (w := t.split()) for j in range(0, len(w), words)] for lang, x in own.items()} for i in (0, 1)]
    for _ in range(passes):
        judges = [_model(half, dictionary_bytes) for half in halves]
        halves = [{lang: _fitting(lang, runs, judge) for lang, runs in half.items()} for half, judge in zip(halves, judges[::-1])]
    own = {lang: halves[0][lang] + halves[1][lang] for lang in texts}
    short = lambda x: sum(map(len, x)) < 1024
    return _model({lang: texts[lang] if short(x) else x for lang, x in own.items()}, dictionary_bytes)


def _fitting(lang: str, runs: list[str], judge: LanguageModel) -> list[str]:
    compressors, out = judge.compressors(), []
    for run in runs:
        found, _, margin = judge.predict(run, compressors)
        if found in (lang, UNKNOWN) or margin < judge.margin:
            out.append(run)
    return out


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with lang_pred, lang_score and lang_rejected; a column of docs with one of these names is replaced.

    A null or empty text, or one without a letter, is `und` with score 0 and rejected, as is any text whose margin
    between the two best languages is under `model.margin` bytes (its best language is still named). Very long texts
    are compressed whole, piece by piece. No dictionaries (no labelled rows): every row is `und`. One narrow pass.
    """
    batched(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = ("lang_pred", "lang_score", "lang_rejected")
    kept = docs.select([c for c in docs.columns if c not in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        compressors = model.compressors()
        for batch in batches:
            found = [model.predict(t, compressors) for t in batch.column("text").to_pylist()]
            new = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[0] == UNKNOWN or f[2] < model.margin for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *added])

    schema = T.StructType([*kept.schema.fields, T.StructField(added[0], T.StringType()), T.StructField(added[1], T.DoubleType()), T.StructField(added[2], T.BooleanType())])
    return kept.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of docs, columns unchanged, whose language `identify` doesn't reject."""
    columns = docs.columns
    return identify(docs, model).where(~F.col("lang_rejected")).select(columns)


def op8_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))
