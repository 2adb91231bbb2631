"""The corpus pipeline, stage by stage, and the registered queries."""

import os

import duckdb
import pytest

import __spark_entry__ as spark_entry
import corpus_pipeline
from ridemetrics.llm import catalog
from ridemetrics.llm.common import materialise
from ridemetrics.llm.line_dedup import CHUNKINGS, UNION_EVERY, line_dedup
from ridemetrics.llm.mixing import mix_sources
from ridemetrics.llm.quality import quality_scores
from ridemetrics.llm.simhash import simhash_components

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], SF_DIR), f"test-{name}"))
    return out


def by_id(df, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in df.collect()}


def test_stages_keep_columns_and_take_effect(spark, stages):
    docs, good, lined, single, mixed, packed = stages
    for df in (good, lined, single, mixed):
        assert df.columns == docs.columns
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    kept = {r.doc_id for r in quality_scores(docs, labels).collect() if r.predicted}
    assert set(by_id(good)) == kept and 0 < len(kept) < docs.count()
    assert by_id(lined, "text") == by_id(line_dedup(good, every=UNION_EVERY, chunkings=CHUNKINGS), "kept_text")
    assert all(n == len(t) for t, n in by_id(lined, "text", "n_chars").values())
    groups = by_id(simhash_components(lined), "component_id")
    assert set(by_id(single)) == {d for d, (c,) in groups.items() if d == c}
    copies = {d: c for d, (c,) in by_id(mix_sources(single), "copies").items() if c}
    found = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert found == copies
    pieces = {}
    for r in packed.collect():
        pieces[r.doc_id] = pieces.get(r.doc_id, 0) + r.length
    assert set(pieces) == set(copies)


def test_clean_documents_stay(stages):
    docs, good, lined, *_ = stages
    # A text whose lines are its own is not touched by the line stage.
    before, after = by_id(good, "text"), by_id(lined, "text")
    own = {}
    for (text,) in before.values():
        for line in set(text.split("\n")):
            own[line] = own.get(line, 0) + 1
    untouched = [d for d, (t,) in before.items() if all(own[x] == 1 for x in t.split("\n")) and len(set(t.split("\n"))) == t.count("\n") + 1]
    assert untouched and all(before[d] == after[d] for d in untouched)


def test_line_stage_reaches_repeated_runs(stages):
    """Of runs of two and more lines that another document has earlier, found line by line, nearly all go."""
    before, after = by_id(stages[1], "text"), by_id(stages[2], "text")
    first, texts, reached, total = {}, set(), 0, 0
    for doc_id in sorted(before):
        text = before[doc_id][0]
        lines = text.split("\n")
        runs = [i for i in range(len(lines) - 1) if first.get((lines[i], lines[i + 1]), doc_id) != doc_id]
        for i in range(len(lines) - 1):
            first.setdefault((lines[i], lines[i + 1]), doc_id)
        if text in texts:
            continue  # exact copies are another stage's matter
        texts.add(text)
        gone = len(lines) - len(after[doc_id][0].split("\n")) if after[doc_id][0] else len(lines)
        repeated = len({k for i in runs for k in (i, i + 1)})
        total += repeated
        reached += min(gone, repeated)
    assert total > 20 and reached >= 0.9 * total


def test_pipeline_of_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (None, "a few words", "en", "s", 11), (2, "", "en", "s", 0), (2, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            frame = materialise(stage(spark, frame, str(tmp_path)), "odd")
    assert frame.count() == 0


def test_one_query_per_operator():
    names = spark_entry.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_oracle(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "embeddings", "labels", "conversations"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    want = connection.execute(catalog.ORACLE[name])
    columns = sorted(d[0] for d in want.description)
    rows = want.fetchall()
    order = [[d[0] for d in want.description].index(c) for c in columns]
    got = catalog.QUERIES[name](spark, SF_DIR)
    assert sorted(got.columns) == columns
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(repr(tuple(r[i] for i in order)) for r in rows)
