"""Language-model scores, sampled segmentations, the registered queries and the pipeline."""

import math
import pathlib
import re
import uuid
import zlib
from collections import Counter

import numpy as np

import __spark_entry__
import corpus_pipeline
from marlstone.llm import common, lm, sentencepieces
from tests.llm.conftest import words

SMALL = "/root/testdata/sf0.001"


def test_language_model_scores(odd, none):
    rows = lm.scores(odd).collect()
    assert len(rows) == odd.count()
    tokens = [(r.doc_id, [*re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or "")), None]) for r in odd.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, t in tokens if not held(i) for w in t)
    total, distinct = sum(c.values()), len(c)
    want = Counter((i, held(i), len(t), sum(c[w] > 0 for w in t), total, round(sum(math.log10((c[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in t), 3)) for i, t in tokens)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in rows) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    assert lm.scores(none).count() == 0


def test_rare_words_are_joined(odd):
    a = {(r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in lm.scores(odd).collect()}
    b = {(r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in lm.scores(odd, vocabulary=5, head=10).collect()}
    assert a == b


def test_the_network_is_fitted_to_every_training_token(odd, tmp_path, monkeypatch):
    def note(params, layout, flat, offsets, rate):
        (tmp_path / uuid.uuid4().hex).write_text(str(len(flat)))
        return params

    monkeypatch.setattr(lm, "train_runs", note)
    total = lm.scores(odd.union(odd.where("doc_id = 8"))).head().train_tokens  # a short text, and again as its copy
    assert sum(int(f.read_text()) for f in tmp_path.iterdir()) == total


def test_lanes_of_unequal_length():
    weights = np.array([5.0, 4, 3, 2, 1])
    layout = lm.Layout(weights, 2)
    p = lm.unpack(lm.initial(weights, layout), 5, layout.classes)
    runs, offsets = np.random.default_rng(3).integers(0, 5, 700).astype(np.int32), np.array([0, 0, 1, 3, 503, 503, 570, 700])
    alone = [lm.score_runs(p, layout, runs[a:b], np.array([0, b - a]))[0] for a, b in zip(offsets[:-1], offsets[1:])]
    assert np.allclose(lm.score_runs(p, layout, runs, offsets), alone, atol=1e-3)


def test_the_network_is_a_distribution_and_learns_order():
    r = np.random.default_rng(0)
    weights = np.array([50.0, 30, 20, 10, 10, 5, 5, 5])
    layout = lm.Layout(weights, 3)
    params = lm.initial(weights, layout)
    p = lm.unpack(params, 8, layout.classes)
    states = r.normal(size=(1, lm.HIDDEN)).astype(np.float32)
    total = sum(math.exp(lm.token_scores(p, layout, states, np.array([k]))[0]) for k in range(8))
    assert abs(total - 1) < 1e-5
    pattern = np.tile(np.array([0, 1, 2, 3, 4, 5, 6, 7]), 400).astype(np.int32)
    offsets = np.arange(0, len(pattern) + 1, 64)
    before = lm.score_runs(p, layout, pattern, offsets).sum()
    for _ in range(80):
        params = lm.train_runs(params, layout, pattern, offsets)
    after = lm.score_runs(lm.unpack(params, 8, layout.classes), layout, pattern, offsets).sum()
    assert after > 0.3 * before  # log-probabilities: the smaller loss


def test_gradients_are_right():
    r = np.random.default_rng(1)
    weights = np.array([5.0, 4, 3, 2, 1])
    layout = lm.Layout(weights, 2)
    flat = r.normal(0, 0.5, sum(math.prod(s) for _, s in lm.shapes(5, layout.classes)))
    inputs, targets = r.integers(0, 5, (4, 2)), r.integers(0, 5, (4, 2))
    starts = np.zeros((4, 2), dtype=bool)
    starts[0] = starts[2, 1] = True
    state = np.zeros((2, lm.HIDDEN), dtype=np.float32)

    def loss(f):
        p = lm.unpack(f.astype(np.float64), 5, layout.classes)
        states, _, _ = lm.forward(p, inputs, starts, state)
        return -lm.token_scores(p, layout, states.reshape(-1, lm.HIDDEN), targets.reshape(-1)).mean()

    got, _ = lm.gradients(lm.unpack(flat, 5, layout.classes), layout, inputs, targets, starts, np.ones((4, 2), dtype=bool), state)
    picks = r.choice(len(flat), 60, replace=False)
    num = []
    for k in picks:
        d = np.zeros(len(flat))
        d[k] = 1e-3
        num.append((loss(flat + d) - loss(flat - d)) / 2e-3)
    scale = np.linalg.norm(got[picks]) / np.linalg.norm(num)
    assert np.allclose(got[picks] / scale, num, atol=5e-3) and 0.2 < scale <= 1.01


def test_windows_carry_the_state(monkeypatch):
    weights = np.array([5.0, 4, 3, 2, 1])
    layout = lm.Layout(weights, 2)
    p = lm.unpack(lm.initial(weights, layout), 5, layout.classes)
    r = np.random.default_rng(2)
    runs, offsets = r.integers(0, 5, 500).astype(np.int32), np.array([0, 3, 203, 204, 500])
    whole = lm.score_runs(p, layout, runs, offsets)
    monkeypatch.setattr(lm, "STEPS", 7)
    monkeypatch.setattr(lm, "LANES", 2)
    assert np.allclose(whole, lm.score_runs(p, layout, runs, offsets), atol=1e-3)


def all_segmentations(pieces, text):
    names = {n: i for i, n in enumerate(pieces.names) if np.isfinite(pieces.logp[i])}
    t = sentencepieces.BLANK + text.replace(" ", sentencepieces.BLANK)

    def go(i):
        if i == len(t):
            yield ()
            return
        for n in range(1, 17):
            if (w := t[i : i + n]) in names and len(w) == n:
                for rest in go(i + n):
                    yield (names[w], *rest)

    return {s: sum(pieces.logp[i] for i in s) for s in go(0)}


def test_samples_have_the_inclusion_chances_of_successive_draws():
    pieces = sentencepieces.Pieces(sentencepieces.default_model())
    lp = all_segmentations(pieces, "the cat")
    z = np.logaddexp.reduce(list(lp.values()))
    p = {s: math.exp(v - z) for s, v in lp.items()}
    n, found, total = 6000, Counter(), 0.0
    for rows in sentencepieces.sampled_texts(pieces, ["the cat"] * n, list(range(n)), 2):
        assert len({tuple(r[0]) for r in rows}) == 2 and rows[0][2] >= rows[1][2]
        for ids, log_prob, _, log_inclusion in rows:
            s = tuple(ids.tolist())
            assert abs(log_prob - (lp[s] - z)) < 1e-5
            found[s] += 1
            total += math.exp(log_prob - log_inclusion)
    for s in sorted(p, key=p.get)[-4:]:
        chance = p[s] + sum(p[a] * p[s] / (1 - p[a]) for a in p if a != s)
        assert abs(found[s] / n - chance) < 0.025
    assert abs(total / n - 1) < 0.03


def test_segmentations_of_odd_rows(odd, none):
    rows = sentencepieces.sampled_segmentations(odd, with_ids=True).collect()
    assert all(r.round_trip for r in rows) and len({r.doc_id for r in rows}) == len({r.doc_id for r in odd.collect()})
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert len(by[5]) == len(by[6]) == 1 and by[5][0].n_pieces == 0
    assert by[10][0].ids != by[10][1].ids and len(by[4]) == 2 * sentencepieces.SAMPLES  # a row and its copy
    assert sentencepieces.sampled_segmentations(none).count() == 0
    back = {r.doc_id: r.text for r in sentencepieces.decoded(sentencepieces.encoded(odd.where("doc_id > 7"))).collect()}
    assert all(back[r.doc_id] == (r.text or "") for r in odd.where("doc_id > 7").collect())


def test_blanks_in_rows():
    pieces = sentencepieces.Pieces(sentencepieces.default_model())
    texts = ["  two  blanks   ", " ", "a", "", None, "x\ny\tz", "日本語 emoji 😀"]
    for t, rows in zip(texts, sentencepieces.sampled_texts(pieces, texts, list(range(7)), 3)):
        assert rows and all(pieces.decode(r[0]).decode() == (t or "") for r in rows)
        assert len({tuple(r[0]) for r in rows}) == len(rows)


def test_every_operator_is_registered_once():
    names = [n for n in __spark_entry__.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in __spark_entry__.queries()


def test_pipeline_stages(spark, spoken, labels, tmp_path):
    good = spoken.select("doc_id", "text", "lang", "source", "n_chars")
    more = [(900, words(900, 60), "en", "h", 1), (901, words(900, 60), "en", "h", 1), (902, "too short", "en", "h", 1), (903, words(903, 60) + ' token="0123456789abcdef" end', "en", "h", 1)]
    docs = good.unionByName(spark.createDataFrame(more, good.schema))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        rows = stage(spark, rows, str(tmp_path))
        assert rows.columns == corpus_pipeline.COLUMNS, name
    kept = {r.doc_id: r.text for r in rows.collect()}
    assert set(kept) == {i for i in range(100, 400) if i % 5} | {900, 903}
    assert "[SECRET]" in kept[903] and "0123456789abcdef" not in kept[903]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(kept) and sum(r.length for r in packed if r.doc_id == 900) > 60


def test_pipeline_on_the_smallest_table(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert rows and set(rows[0].asDict()) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}


def plain_gru(p, layout, ids):
    """The log-probability of one document, token by token, by the equations."""
    n, h, out = len(layout.cls), np.zeros(lm.HIDDEN), 0.0
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    before = n
    for t in ids:
        zr = sigmoid(p["xg"][before].astype(float) + h @ p["ug"])
        z, r = zr[: lm.HIDDEN], zr[lm.HIDDEN :]
        new = np.tanh(p["xn"][before] + r * (h @ p["un"]))
        h = (1 - z) * new + z * h
        logits = h @ p["cw"] + p["cb"]
        c = layout.cls[t]
        a, b = layout.first[c], layout.first[c + 1]
        within = h @ p["ww"][:, a:b] + p["wb"][a:b]
        out += logits[c] - np.log(np.exp(logits).sum()) + within[t - a] - np.log(np.exp(within).sum())
        before = t
    return out


def test_scores_by_the_equations():
    r = np.random.default_rng(9)
    weights = np.sort(r.uniform(1, 50, 40))[::-1]
    layout = lm.Layout(weights, 6)
    flat = lm.initial(weights, layout) + r.normal(0, 0.3, len(lm.initial(weights, layout))).astype(np.float32)
    p = lm.unpack(flat, 40, layout.classes)
    docs = [r.integers(0, 40, n) for n in (1, 70, 3, 200, 33)]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    got = lm.score_runs(p, layout, np.concatenate(docs).astype(np.int16), offsets)
    assert np.allclose(got, [plain_gru(p, layout, d) for d in docs], rtol=1e-4)


def test_scores_do_not_depend_on_batches(odd, monkeypatch):
    a = {(r.doc_id, r.n_tokens): round(r.score, 2) for r in lm.scores(odd).collect()}
    monkeypatch.setattr(lm, "SCORE_TOKENS", 50)
    b = {(r.doc_id, r.n_tokens): round(r.score, 2) for r in lm.scores(odd).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 0.02 + 1e-4 * abs(a[k]) for k in a)


def test_the_network_beats_the_base_on_held_out_documents(spark):
    rows = lm.query(spark, "/root/testdata/sf0.01").where("held_out").collect()
    tokens = sum(r.n_tokens for r in rows)
    assert len(rows) > 100 and sum(r.score for r in rows) / tokens > sum(r.base_score for r in rows) / tokens + 0.02


def test_samples_depend_on_the_key_alone():
    pieces = sentencepieces.Pieces(sentencepieces.default_model())
    texts = [words(k, 5 + k) for k in range(12)]
    whole = list(sentencepieces.sampled_texts(pieces, texts, list(range(12)), 3))
    for k in (0, 5, 11):
        (alone,) = sentencepieces.sampled_texts(pieces, [texts[k]], [k], 3)
        assert [(a[0].tolist(), round(a[1], 4)) for a in alone] == [(a[0].tolist(), round(a[1], 4)) for a in whole[k]]


def test_pipeline_of_odd_tables(spark, labels, tmp_path):
    good, other = words(31, 50), words(32, 50)
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, `__row` int, kept boolean, __host string"
    rows = [(1, good, "en", "h", 1), (1, good, "en", "h", 1), (1, other, "en", None, 1), (2, None, None, None, None), (3, "", "en", "h", 0), (None, words(33, 50), None, "h", 2), (None, words(33, 50), None, "h", 2), (4, words(34, 30000), "en", "h", 9), (5, 'token = "abcdefgh12345678" ' + words(35, 40), "en", "h", 9)]
    for name, table in (("odd", spark.createDataFrame([(*r, 0.5, 1, True, "x") for r in rows], schema)), ("empty", spark.createDataFrame([], schema))):
        folder = tmp_path / name
        table.write.parquet(str(folder / "documents.parquet"))
        labels.write.parquet(str(folder / "labels.parquet"))
        docs = spark.read.parquet(str(folder / "documents.parquet"))
        for _, stage in corpus_pipeline.STAGES[:4]:
            docs = stage(spark, docs, str(folder))
            assert docs.columns == corpus_pipeline.COLUMNS
        got = {(r.doc_id, r.text) for r in docs.collect()}
        if name == "empty":
            assert got == set() and corpus_pipeline.run(spark, str(folder)).count() == 0
            continue
        assert got == {(1, good), (1, other), (None, words(33, 50)), (4, words(34, 30000)), (5, f"[SECRET]\" {words(35, 40)}")}
        packed = corpus_pipeline.run(spark, str(folder)).collect()
        assert {r.doc_id for r in packed} == {1, None, 4, 5} and len({r.piece for r in packed if r.doc_id == 4}) > 5


def test_pipeline_tables_are_few_files(spark, spoken, labels, tmp_path):
    """Files cost executors processes: what native operators make of few rows is a file for each core at most, however many splits
    and shuffle partitions there are, and the rows are the same."""
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spoken.select(*corpus_pipeline.COLUMNS).union(spoken.selectExpr("doc_id + 1000", "text", "lang", "source", "n_chars"))
    few = spark.sparkContext.defaultParallelism
    docs.repartition(5 * few).write.parquet(f"{tmp_path}/0")
    folder = pathlib.Path(common.scratch_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    held = {"spark.sql.shuffle.partitions": str(5 * few), "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.files.maxPartitionBytes": "1k", "spark.sql.files.openCostInBytes": "1k"}
    were = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, spark.read.parquet(f"{tmp_path}/{number}"), str(tmp_path)).write.parquet(f"{tmp_path}/{number + 1}")
            assert name not in ("quality rules", "near copies") or len(list((tmp_path / str(number + 1)).glob("part-*"))) <= few, name
    finally:
        for k, v in were.items():
            spark.conf.set(k, v)
    files = {p.name.rsplit("-", 1)[0]: len(list(p.glob("part-*"))) for p in set(folder.iterdir()) - before}
    assert {"quality-rows", "sets", "verified", "classes"} <= set(files)
    assert all(n <= few for label, n in files.items() if label not in ("toxic-sample", "toxic-counts", "sketches", "pieces")), files
    ids = {r.doc_id for r in spark.read.parquet(f"{tmp_path}/4").collect()}
    assert ids and ids == {r.doc_id for r in spark.read.parquet(f"{tmp_path}/2").collect() if r.doc_id < 1000}
    assert {r.doc_id for r in spark.read.parquet(f"{tmp_path}/5").collect()} == ids


def test_pipeline_by_brute_force(spark):
    """The stages on the driver's smallest table: rules in plain Python, copies by comparing all pairs, masks by the scan."""
    from tests.llm.test_joins_and_packing import brute, shingle_set
    from tests.llm.test_text_operators import plain_counts

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    stages = [f for _, f in corpus_pipeline.STAGES]
    good = stages[0](spark, docs, SMALL).collect()
    assert {r.doc_id for r in good} == {r.doc_id for r in docs.collect() if not plain_counts(r.text)[-1]}  # no host is an outlier
    clean = stages[1](spark, spark.createDataFrame(good, docs.schema), SMALL).collect()
    toxic = {r.doc_id for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("toxic = 1").collect()}
    assert {r.doc_id for r in clean} <= {r.doc_id for r in good} and len(clean) > 0.7 * len([r for r in good if r.doc_id not in toxic])
    one = stages[2](spark, spark.createDataFrame(clean, docs.schema), SMALL).collect()
    _, root = brute({r.doc_id: shingle_set(r.text) for r in clean})
    assert sorted(r.doc_id for r in one) == sorted(set(root.values()))
    from marlstone.llm import secrets

    masked = {r.doc_id: r.text for r in stages[3](spark, spark.createDataFrame(one, docs.schema), SMALL).collect()}
    assert masked == {r.doc_id: secrets.redact(r.text) for r in one}
