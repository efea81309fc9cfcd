import math

import numpy as np
import pyarrow as pa
from lodeleaf.config import Config
from lodeleaf.functions.embedding import tokens_of
from lodeleaf.operators import evaluate, fusion, mmr, sections
from lodeleaf.operators.filters import visible, visible_to
from lodeleaf.plans import block, queries as Q, retrieve
from pyspark.sql import functions as F

CHUNKS = "chunk_id string, doc_id string, seq int, text string, acl string, tags array<string>, vec array<double>"
TEXTS = ["alpha beta beta", "beta gamma", "", None, "alpha alpha delta", "gamma 中文 中", "beta beta beta"]


def chunks(spark):
    return spark.createDataFrame([(f"d{i // 2}:{i % 2}", f"d{i // 2}", i % 2, t, "hr" if i == 4 else "public", ["x"] if i % 2 else None, [float(i), 1.0]) for i, t in enumerate(TEXTS)], CHUNKS)


def brute_bm25(texts, query):
    docs = [tokens_of(t or "") for t in texts]
    mean = sum(map(len, docs)) / len(docs) or 1.0
    out = []
    for d in docs:
        s = 0.0
        for term in dict.fromkeys(tokens_of(query)):
            f, n = d.count(term), sum(term in x for x in docs)
            s += math.log(1 + (len(docs) - n + 0.5) / (n + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * max(1, len(d)) / mean))
        out.append(s)
    return out


def ready(spark, rows, **config):
    q = spark.createDataFrame(rows, "query_id long, query string, acls array<string>, tags array<string>, vec array<double>")
    return retrieve.prepared(q, Config(**config), None)


def test_bm25_is_scoped_to_what_a_query_sees(spark):
    q = ready(spark, [(1, "beta 中 alpha beta", None, None, [1.0, 0.0]), (2, "alpha", ["public"], None, [1.0, 0.0]), (3, "beta", None, ["x"], [1.0]), (4, "beta", [], None, [1.0, 0.0]), (5, "", None, None, [0.0, 0.0])])
    rows = retrieve.scored(q, retrieve.ready(chunks(spark)), 10).collect()
    ids = [f"d{i // 2}:{i % 2}" for i in range(len(TEXTS))]
    for qid, query, seen in ((1, "beta 中 alpha", range(7)), (2, "alpha", [0, 1, 2, 3, 5, 6]), (3, "beta", [1, 3, 5]), (4, "beta", []), (5, "", range(7))):
        got = {r.chunk_id: r.lex for r in rows if r.query_id == qid}
        want = dict(zip([ids[i] for i in seen], brute_bm25([TEXTS[i] for i in seen], query) if seen else [], strict=True))
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert all(r.vec_score is None for r in rows if r.query_id == 3)  # another size


def test_filters(spark):
    df = spark.createDataFrame([("a", ["x"]), ("b", None), (None, ["y"])], "acl string, tags array<string>")

    def n(acls, tags):
        lit = lambda v: F.lit(None).cast("array<string>") if v is None else F.array(*map(F.lit, v)).cast("array<string>")
        both = [df.filter(visible(F.col("acl"), F.col("tags"), lit(acls), lit(tags))).count(), df.filter(visible_to(acls, tags)).count()]
        assert both[0] == both[1]
        return both[0]

    assert [n(None, None), n([], None), n(["a"], None), n(None, ["x", "y"]), n(["b"], ["x"]), n(None, [])] == [3, 0, 1, 2, 0, 3]


def test_rrf_ties_keep_the_vector_order(spark):
    rows = [(1, "A", "d", 0, 9.0, 1.0), (1, "B", "d", 1, 8.0, 2.0), (1, "C", "d", 2, 7.0, 0.0)]
    df = spark.createDataFrame(rows, "query_id long, chunk_id string, doc_id string, seq int, vec_score double, lex double")
    got = fusion.fuse(fusion.pools(df, 50)).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["A", "B", "C"] and got[0].score == got[1].score == 1 / 61 + 1 / 62
    flat = spark.createDataFrame([(1, c, "d", i, 0.5, 0.0) for i, c in enumerate("XYZ")], df.schema)
    assert [r.chunk_id for r in fusion.fuse(fusion.pools(flat, 50), "weighted").orderBy("rank").collect()] == ["X", "Y", "Z"]
    small = fusion.pools(df, 1)
    assert {(r.chunk_id, r.vec_rank, r.lex_rank) for r in small.collect()} == {("A", 1, None), ("B", None, 1)}
    assert fusion.at_least(fusion.fuse(small), 0.0).count() == 2 and fusion.at_least(fusion.fuse(small), 0.9).count() == 0


def brute_mmr(score, vec, k, lam):
    rng = (max(score) - min(score)) or 1.0
    rel = [(s - min(score)) / rng for s in score]
    chosen, left = [], list(range(len(score)))
    while left and len(chosen) < k:
        best = max(left, key=lambda i: (rel[i] - lam * max((float(np.dot(vec[i], vec[j])) for j in chosen), default=0.0), -i))
        chosen.append(best)
        left.remove(best)
    return chosen


def test_mmr_against_brute_force(spark):
    rng = np.random.default_rng(3)
    for n, k, lam in ((1, 5, 0.3), (12, 5, 0.3), (12, 12, 0.9), (6, 3, 0.0)):
        vec, score = rng.normal(size=(n, 4)), sorted(rng.random(n), reverse=True)
        assert mmr.pick(np.array(score), vec, k, lam) == brute_mmr(score, vec, k, lam)
    df = spark.createDataFrame([(1, "a", 1, 0.9, [1.0, 0.0]), (1, "b", 2, 0.89, [1.0, 0.0]), (1, "c", 3, 0.88, [0.0, 1.0]), (2, "z", 1, 0.1, None)], "query_id long, chunk_id string, rank int, score double, vec array<double>")
    got = {(r.query_id, r.final_rank): r.chunk_id for r in mmr.mmr(df, 0.9, 2).collect()}
    assert got == {(1, 1): "a", (1, 2): "c", (2, 1): "z"}


RANKED = "query_id long, chunk_id string, doc_id string, section string, score double, rank int, start_pos int, text string"


def test_sections(spark):
    ranked = spark.createDataFrame([(1, "a", "d", "X > Y", 0.9, 1, 50, "t" * 300), (1, "b", "d", "Z", 0.5, 2, 90, "u"), (1, "c", "d", "", 0.4, 3, 0, "v"), (1, "e", "d", "W", 0.1, 4, 5, "w"), (2, "f", "d", None, 0.3, 1, 1, "x")], RANKED)
    tree = spark.createDataFrame([("d", 0, "X", 1, None), ("d", 1, "X > Y", 2, "X"), ("d", 2, "Z", 1, None), ("d", 3, "W", 1, None), ("d", 4, "none", 1, None)], "id string, ordinal int, section string, level int, parent string")
    nodes = sections.scores(ranked, tree)
    assert [(r.section, r.score) for r in nodes.filter("query_id = 1").orderBy("place").collect()] == [("X", 0.9), ("X > Y", 0.9), ("Z", 0.5), ("W", 0.1)]
    kept = sections.keep_selected(ranked, sections.first_sections(nodes, 3)).orderBy("query_id", "rank").collect()
    assert [r.chunk_id for r in kept] == ["a", "b", "c", "f"]
    none = spark.createDataFrame([(1, "nowhere", 1)], "query_id long, section string, place int")
    only = ranked.filter("section <> '' and query_id = 1")
    assert [r.chunk_id for r in sections.keep_selected(only, none).orderBy("rank").collect()] == ["a", "b", "e"]
    assert {r.section: len(r.snippet) for r in sections.snippets(ranked).collect()}["X > Y"] == 200


def test_evaluation(spark):
    results = spark.createDataFrame([(1, 2, "/kb/Leave.md", "T"), (1, 1, "/kb/a", None), (2, 1, None, None)], "query_id long, rank int, path string, title string")
    qrels = spark.createDataFrame([(1, ["leave"]), (2, ["zz"]), (3, [""])], "query_id long, relevant array<string>")
    ranks = evaluate.first_ranks(results, qrels)
    assert {r.query_id: r.first_rank for r in ranks.collect()} == {1: 2, 2: None, 3: None}
    assert tuple(evaluate.summary(ranks, 3).first()) == (3, 0.3333, 0.1667)
    assert tuple(evaluate.summary(ranks.limit(0), 3).first()) == (0, 0.0, 0.0)


def test_searches_take_every_id_divisible_by_50(spark, tmp_path, monkeypatch):
    import hashlib

    rng = np.random.default_rng(3)
    rows = [(f"d{i % 40}:{i}", f"d{i % 40}", i, f"text {i} word{i % 7}", "hashing", 8, rng.normal(size=8).tolist(), "public", ["a"]) for i in range(600)]
    ddl = "chunk_id string, doc_id string, seq int, text string, embedder string, dim int, vec array<double>, acl string, tags array<string>"
    spark.createDataFrame(rows, ddl).write.parquet(str(tmp_path / "chunks.parquet"))
    number = {r[0]: int(hashlib.md5(r[0].encode()).hexdigest()[:15], 16) for r in rows}
    queries = [r for r in rows if number[r[0]] % 50 == 0]
    assert len(queries) > 5
    blocks = retrieve.query_blocks
    monkeypatch.setattr(retrieve, "query_blocks", lambda q: blocks(q, 4))
    want = {}
    for q in queries:
        best = sorted(rows, key=lambda r: (-float(np.dot(r[6], q[6])), r[1], r[2]))[:10]
        want[number[q[0]]] = [r[0] for r in best]
    got = Q.QUERIES["vector_topk"](spark, str(tmp_path)).collect()
    assert {k: [r.chunk_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == k] for k in {r.query_id for r in got}} == want
    assert {r.query_id for r in Q.QUERIES["bm25_topk"](spark, str(tmp_path)).collect()} == set(want)


def test_docs_listing_has_every_document(spark, tmp_path):
    import datetime as dt

    rows = [(f"d{i:03d}", f"t{i}", None, ["b", "a"], dt.datetime(2024, 1, 1 + i % 9, i % 5)) for i in range(260)]
    spark.createDataFrame(rows, "doc_id string, title string, source_hash string, tags array<string>, updated_at timestamp").write.parquet(str(tmp_path / "kb_documents.parquet"))
    got = sorted(Q.QUERIES["docs_listing"](spark, str(tmp_path)).collect(), key=lambda r: r.place)
    assert [r.doc_id for r in got] == [r[0] for r in sorted(rows, key=lambda r: (-r[4].timestamp(), r[0]))]
    assert [r.place for r in got] == list(range(1, 261)) and got[0].tags == "a,b"


def test_section_scores_keeps_places_beyond_20(spark, monkeypatch):
    ranked = spark.createDataFrame([(1, f"c{i}", "d", f"S{i:02d}", 1.0 - i / 100) for i in range(30)], "query_id long, chunk_id string, doc_id string, section string, score double")
    tree = spark.createDataFrame([("d", f"S{i:02d}", 1, i, None) for i in range(30)], "id string, section string, level int, ordinal int, parent string")
    monkeypatch.setattr(Q, "_candidates", lambda *a: ranked)
    monkeypatch.setattr(Q, "_tree", lambda *a: tree)
    got = Q.QUERIES["section_scores"](spark, "").collect()
    assert {(r.section, r.place) for r in got} == {(f"S{i:02d}", i + 1) for i in range(30)}


def test_tasks_keep_the_best_of_many_batches(spark, monkeypatch):
    """Ties go by document and place, across batches and compactions; what isn't seen takes no part."""
    from lodeleaf.plans import block

    monkeypatch.setattr(block, "ROWS", 3)
    rows = [(f"d{i % 7}:{i}", f"d{i % 7}", i, "alpha" if i % 3 else "alpha beta", "public" if i % 2 else "team", ["x"], [float(i % 4), 1.0]) for i in range(400)]
    df = spark.createDataFrame(rows, "chunk_id string, doc_id string, seq int, text string, acl string, tags array<string>, vec array<double>").coalesce(1)
    q = ready(spark, [(1, "beta", None, None, [1.0, 0.0]), (2, "alpha", ["team"], None, [1.0, 0.0]), (3, "none", [], None, [1.0, 0.0])])
    got = retrieve.scored(q, retrieve.ready(df), 5)
    for qid, seen in ((1, rows), (2, [r for r in rows if r[4] == "team"])):
        best = [r.chunk_id for r in fusion.top(got.filter(F.col("query_id") == qid), "vec_score", "rank", 5).orderBy("rank").collect()]
        assert best == [r[0] for r in sorted(seen, key=lambda r: (-r[6][0], r[1], r[2]))[:5]]
    lex = [r.chunk_id for r in fusion.top(got.filter("query_id = 1"), "lex", "rank", 5).orderBy("rank").collect()]
    assert lex == [r[0] for r in sorted(rows, key=lambda r: (r[3] == "alpha", r[1], r[2]))[:5]] and got.filter("query_id = 3").count() == 0
    assert retrieve.scored(q.limit(0), retrieve.ready(df), 5).count() == 0 and retrieve.scored(q, retrieve.ready(df.limit(0)), 5).count() == 0


def test_block_scores_few_pairs_exactly_and_ranks_as_brute_force(monkeypatch):
    rng = np.random.default_rng(3)
    n, n_queries, d, limit = 900, 40, 16, 10
    x, q = rng.normal(size=(n, d)), rng.normal(size=(n_queries, d))
    x[100:140] = x[7]  # equal scores
    x[3], x[4], x[5], q[1] = 0, x[6] * 1e200, x[6] * 1e-20, q[1] * 1e-30  # what 32 bits can't hold
    words = [f"w{k}" for k in range(60)]
    tokens = [[words[int(60 * u * u)] for u in rng.random(rng.integers(0, 30))] for _ in range(n)]
    tokens[200:260] = [tokens[9]] * 60
    asked = [[words[k] for k in rng.choice(60, 8, replace=False)] for _ in range(n_queries - 2)] + [[], ["none"]]
    rows = [{"query_id": k, "q_terms": asked[k], "q_vec": q[k].tolist(), "acls": None, "wanted": None, "top_k": None} for k in range(n_queries)]
    names = [f"c{k:04d}" for k in range(n)]
    source = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in ((names, pa.string()), (names, pa.string()), ([0] * n, pa.int32()), ([None] * n, pa.string()), ([None] * n, pa.list_(pa.string())), (x.tolist(), pa.list_(pa.float64())), (tokens, pa.list_(pa.string())))], names=block.NEEDED)
    own = block.Block(rows)
    own.mean[:] = sum(map(len, tokens)) / n
    df = np.array([sum(t in s for s in tokens) for t in own.vocabulary.to_pylist()])
    own.share[:] = df / n
    own.idf[:] = np.log(1 + (n - df + 0.5) / (df + 0.5))[own.term]
    lex = np.zeros((n_queries, n))
    for e in own.entries:
        f = np.array([s.count(own.vocabulary[own.term[e]].as_py()) for s in tokens])
        lex[own.query[e]] += own.idf[e] * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * np.maximum([len(s) for s in tokens], 1) / own.mean[own.query[e]]))
    vec = np.zeros((n_queries, n))
    for k in range(d):
        vec += q[:, k : k + 1] * x[:, k]
    scored = []
    exact = block._Vectors.exact
    monkeypatch.setattr(block._Vectors, "exact", lambda self, q, *more: scored.append(len(q)) or exact(self, q, *more))
    for rare in (1e-9, 1e9):  # all terms by columns, all by postings
        monkeypatch.setattr(block, "DENSE", rare)
        for size, segment in ((64, 200), (1024, 16_384)):
            monkeypatch.setattr(block, "ROWS", size)
            monkeypatch.setattr(block, "SEGMENT", segment)
            scored.clear()
            got = {}
            for r in pa.Table.from_batches(block._keep(own, limit, True)(iter([source]))).to_pylist():
                got[r["query_id"], int(r["chunk_id"][1:])] = r["vec_score"], r["lex"]
            assert sum(scored) < n * n_queries / 3
            for k in range(n_queries):
                for by in (vec, lex):
                    first = np.argsort(-by[k], kind="stable")[:limit]
                    assert all(got[k, i] == (vec[k, i], lex[k, i]) for i in first)


def test_searches_take_each_chunk_once_without_moving_it(spark, tmp_path):
    """Repeated rows within a file and between files, and of no id; only ids are shuffled."""
    rows = [(None if i % 40 == 3 else f"c{i % 90:02d}", f"text {i % 90}", [float(i % 90), 1.0], 2, "hashing") for i in range(120)]
    df = spark.createDataFrame(rows + [("c07", "text 7", [7.0, 1.0], 2, "hashing")] * 3, "chunk_id string, text string, vec array<double>, dim int, embedder string")
    df.repartition(3).write.parquet(f"{tmp_path}/chunks.parquet")
    once = Q._once(spark, str(tmp_path))
    got = [(r.chunk_id, r.text) for r in once.collect()]
    assert len(got) == len(set(got)) and sorted(map(str, (c for c, _ in got))) == sorted(map(str, {r[0] for r in rows}))
    vectors = Q._vectors(spark, str(tmp_path))
    assert vectors.count() == len(got) and "hashpartitioning" not in vectors._jdf.queryExecution().executedPlan().toString()


def test_picked_sentences_tokenize_a_query_once_for_all_sentences(spark):
    from lodeleaf.operators import answer

    df = spark.createDataFrame([(1, 1, "beta 中文 beta", "Alpha. Beta one! 中文 beta? \nGamma beta"), (2, 1, "none", " ")], "query_id long, position int, query string, text string")
    picked = answer.picked_sentences(df)
    assert [(r.query_id, r.pick, r.sentence_no, r.sentence, r.overlap) for r in picked.orderBy("query_id", "pick").collect()] == [(1, 1, 2, "中文 beta?", 4), (1, 2, 1, "Beta one!", 1)]
    plan = picked._jdf.queryExecution().optimizedPlan().toString().split("\n")
    sentences = next(i for i, line in enumerate(plan) if "posexplode" in line)
    assert not any("lower(query" in line for line in plan[:sentences]) and any("query" in line for line in plan[sentences:])


def test_groups_of_queries_and_chunks_leave_the_scores_as_they_are(spark, monkeypatch):
    """Two languages that share a word: few terms have columns for a pair of groups, and the first rows are those of one group for all."""
    rng = np.random.default_rng(5)
    texts = [" ".join([f"{'ab'[i % 2]}{int(40 * u * u)}" for u in rng.random(20)] + ["both"] * (i % 3)) for i in range(700)] + ["", "alien"]
    rows = [(f"d{i % 9}:{i}", f"d{i % 9}", i, t, "public", None, rng.normal(size=4).tolist()) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, CHUNKS).coalesce(2)
    q = ready(spark, [(i, texts[i] if i < 158 else "", None, None, rows[i][6]) for i in range(160)])
    monkeypatch.setattr(block, "ROWS", 64)
    monkeypatch.setattr(block, "HELD", 300)
    asked = q.orderBy("query_id").collect()
    found = {}
    for least in (16, 1000):
        monkeypatch.setattr(block, "LEAST_GROUP", least)
        rows_by_group, groups, centres = block._grouped(asked)
        assert (len(groups) > 2) == (least == 16) and sorted(r["query_id"] for r in rows_by_group) == list(range(160)) and bool(centres) == (least == 16)
        got = retrieve.scored(q, retrieve.ready(df), 5)
        found[least] = [fusion.top(got, s, "rank", 5).select("query_id", "rank", "chunk_id", "vec_score", "lex").orderBy("query_id", "rank").collect() for s in ("lex", "vec_score")]
    assert found[16] == found[1000] and len(found[16][0]) == 800
    monkeypatch.setattr(block, "LEAST_GROUP", 16)
    own = block.Block(*block._grouped(asked))
    own.share[:] = 0.3
    columns = [len(terms) for part in block._Lexical(own).dense for terms, _ in part]
    assert min(columns) < 0.5 * max(columns)
    scoped = ready(spark, [(i, texts[i], ["public"], None, rows[i][6]) for i in range(160)]).collect()
    assert block._grouped(scoped)[1] == [0, 160]
