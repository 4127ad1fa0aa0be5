"""The registered queries and the pipeline's stages over small tables: columns, whole results, and contracts."""

import re
import shutil
import sys
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline
from sparkloom.llm import common
from sparkloom.llm.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = {
    "op1_lm_scoring": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op2_source_mixing": "doc_id size source_size target taken",
    "op3_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op4_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op5_toxicity": "doc_id held_out score predicted",
    "op6_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op7_minhash_near_dedup": "doc_id n_shingles component_id kept",
    "op8_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op9_html_extraction": "page_id url text n_chars",
    "op10_warc_derivatives": "page_id record_id kind refers_to",
}
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """The small tables, with documents dealt over several files and rows that are null, empty and repeated."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    out = tmp_path_factory.mktemp("tables")
    for p in DATA.glob("*.parquet"):
        shutil.copyfile(p, out / p.name)
    t = pq.read_table(out / "documents.parquet")
    odd = pa.table({"doc_id": pa.array([9001, 9002, 9003, 9003, None], t.schema.field("doc_id").type), "text": pa.array([None, "", "w " * 3000, "w " * 3000, "only one"], t.schema.field("text").type), "lang": pa.array([None, "en", "en", "en", None], t.schema.field("lang").type), "source": pa.array([None, "src0", "src0", "src0", None], t.schema.field("source").type), "n_chars": pa.array([None, 0, 6000, 6000, 8], t.schema.field("n_chars").type)})
    pq.write_table(pa.concat_tables([t, odd.select(t.column_names)]), out / "documents.parquet")
    pages = pq.read_table(out / "pages.parquet")
    more = pa.table({"page_id": pa.array([900, 900], pages.schema.field("page_id").type), "url": pa.array([None, None], pages.schema.field("url").type), "html": pa.array([None, None], pages.schema.field("html").type)})
    pq.write_table(pa.concat_tables([pages, more]), out / "pages.parquet")
    return str(out)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_row_is_answered(spark, folder, name):
    df = QUERIES[name](spark, folder)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    rows = df.collect()
    table = "pages" if "page_id" in df.columns else "documents"
    whole = spark.read.parquet(f"{folder}/{table}.parquet").collect()
    key = "page_id" if table == "pages" else "doc_id"
    if name not in ("op3_best_fit_packing", "op10_warc_derivatives"):
        assert sorted(str(r[key]) for r in rows) == sorted(str(r[key]) for r in whole)
    assert {r[key] for r in rows} == {r[key] for r in whole}
    text = {r.doc_id: r.text or "" for r in whole} if table == "documents" else {}
    if name == "op8_quality_rules":
        for r in rows:
            assert r.n_words == len(WORD.findall(text[r.doc_id])) and r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)
    if name in ("op1_lm_scoring", "op5_toxicity"):
        fold, rest = (7, 2) if name[2] == "1" else (4, 2)
        assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % fold == rest) for r in rows)
    if name == "op5_toxicity":
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    if name == "op1_lm_scoring":
        assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)
    if name == "op2_source_mixing":
        assert all(r.taken <= 2 * r["size"] for r in rows)
    if name == "op9_html_extraction":
        assert all(r.n_chars == len(r.text) for r in rows)


def test_oracles(spark, folder):
    duckdb = pytest.importorskip("duckdb")
    for name, sql in ORACLES.items():
        con = duckdb.connect()
        for p in DATA.glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        df = QUERIES[name](spark, str(DATA))
        columns = sorted(df.columns)
        got = sorted(tuple(r[c] for c in columns) for r in df.collect())
        result = con.execute(sql)
        names = [c[0] for c in result.description]
        assert sorted(names) == columns
        assert sorted(tuple(r[names.index(c)] for c in columns) for r in result.fetchall()) == got, name


def test_stages_keep_columns_and_decisions_take_effect(spark, folder):
    docs = common.table(spark, folder, "documents")
    for name in ("digest", "size", "bucket", "t_lang", "t_symbols_pm", "q_kept", "q_limit_t_lang", "x_file", "x_row", "copies", "id", "rid", "cid", "k0", "part", "normal", "best", "a.b", "_metadata_"):
        docs = docs.withColumn(name, F.lit(None).cast("string") if name == "x_file" else F.lit(1))
    docs.write.parquet(f"{folder}/clash")
    docs, counts = spark.read.parquet(f"{folder}/clash"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns, name
            docs = common.stored(out, f"t-{name}")
            counts.append(docs.count())
        else:
            sequences = out.groupBy("sequence_id").agg(F.sum("length").alias("n"))
            assert sequences.where("n > 2048").count() == 0 and {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
    assert counts[0] > counts[1] >= counts[2] > 0 and counts[0] < 206
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_empty_tables(spark, tmp_path):
    for t in ("documents", "pages", "labels"):
        spark.read.parquet(f"{DATA}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, query in QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
