"""The pipeline's stages against brute force, each on its own input."""

import re

import pytest

import corpus_pipeline
from corvid.llm.common import materialize, table
from corvid.llm.queries import oracle_sql, queries, piece_model_path
from tests.llm.test_ops import linked, sha, words


def test_stages(spark, sf_dir):
    import duckdb
    import sentencepiece

    rows = {}
    docs = table(spark, sf_dir, "documents")
    rows["documents"] = {r.doc_id: r for r in docs.collect()}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        rows[name] = {r.doc_id: r for r in docs.collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    base, good, lines, single, clean, final = rows.values()

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert set(good) == {r[0] for r in con.sql(f"SELECT doc_id FROM ({oracle_sql()['op8_quality']}) WHERE kept").fetchall()}

    seen, want = [], {}
    for i in sorted(good):
        kept = []
        for x in good[i].text.split("\n"):
            ws = words(x)
            s = set(ws) if ws else None
            if s is None or not any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                kept.append(x)
            if s is not None:
                seen.append(s)
        if any(words(x) for x in kept):
            want[i] = "\n".join(kept)
    assert {i: r.text for i, r in lines.items()} == want
    assert all(r.n_chars == len(r.text) for r in lines.values())

    assert set(single) == {w[0] for w in linked([(i, r.text) for i, r in lines.items()], 5, 80) if w[3]}
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    low = lambda s: s.translate({i: i + 32 for i in range(65, 91)})
    wins = set()
    for r in table(spark, sf_dir, "benchmark").collect():
        ws = find(low(r.text))
        k = min(10, len(ws))
        wins |= {tuple(ws[a : a + k]) for a in range(len(ws) - k + 1)} if ws else set()
    hit = lambda t: any(tuple(ws[a : a + k]) in wins for ws in [find(low(t))] for k in {len(w) for w in wins} for a in range(len(ws) - k + 1))
    assert set(clean) == {i for i, r in single.items() if not hit(r.text)}
    lib = sentencepiece.SentencePieceProcessor(model_file=piece_model_path())
    for i, r in final.items():
        ids = lib.encode(clean[i].text)
        assert (r.n_tokens, r.ids, r.decoded_sha256) == (len(ids), ",".join(map(str, ids)), sha(lib.decode(ids).encode()))
    assert set(final) == set(clean)


def run_on(spark, path, docs, items):
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return corpus_pipeline.run(spark, str(path)).collect()


def test_run_takes_odd_tables(spark, docs, nothing, tmp_path):
    rows = run_on(spark, tmp_path / "odd", docs, [(1, None), (2, ""), (None, "x y")])  # nulls, long texts, clashing columns
    ids = [r.doc_id for r in rows]
    assert rows and len(set(ids)) == len(ids) and all(r.n_tokens for r in rows)
    assert run_on(spark, tmp_path / "empty", nothing, []) == []
    assert run_on(spark, tmp_path / "nulls", spark.createDataFrame([(None,) * len(docs.columns)] * 3, docs.schema), []) == []
    text = " ".join(f"word{k}" for k in range(60))
    twice = spark.createDataFrame([(1, text, "en", "s", len(text))] * 2 + [(2, text + " more", None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in run_on(spark, tmp_path / "twice", twice, [])) == [1, 1]  # a repeated row is one document, a near copy goes
    assert run_on(spark, tmp_path / "known", twice, [(7, text)]) == []


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries()[name](spark, sf_dir)
    rel = con.sql(oracle_sql()[name])
    assert sorted(rel.columns) == sorted(df.columns)
    assert sorted(map(str, df.select(*rel.columns).rdd.map(tuple).collect())) == sorted(map(str, rel.fetchall()))
