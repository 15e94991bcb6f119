"""The pipeline's stages, each against a plain version on its own input, and secret scans on planted findings."""

import random
import uuid

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pulsegate.llm import decontaminate, quality_rules, secret_scan, simhash_dedup, token_counts
from pulsegate.llm.common import store
from pulsegate.llm.queries import ORACLES, QUERIES
from tests.llm import brute
from tests.llm.conftest import rows_of


@pytest.fixture(scope="module")
def staged(spark, sf):
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        kept.append(docs)
        docs = store(stage(spark, docs, sf), f"test-{name}")
    return [*kept, docs]


def ids(frame):
    return sorted(r.doc_id for r in frame.select("doc_id").collect())


def test_columns_stay_until_the_last_stage(staged):
    assert all(f.columns == staged[0].columns for f in staged[:-1])


def test_quality_stage(staged, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert ids(staged[1]) == sorted(r[0] for r in con.sql(f"SELECT doc_id FROM ({quality_rules.ORACLE}) WHERE kept").fetchall())


def test_near_dedup_stage(staged):
    rows = [(r.doc_id, r.text) for r in staged[1].collect()]
    prints = np.stack([simhash_dedup.fingerprint(t, 5, 4) for _, t in rows])
    near = [(i, j, int(np.bitwise_count(prints[i] ^ prints[j]).sum())) for i in range(len(rows)) for j in range(i)]

    def first_of_groups(distance):
        groups = {}
        for label, (doc, _) in zip(brute.labels(len(rows), [(i, j) for i, j, d in near if d <= distance]), rows):
            groups.setdefault(label, []).append(doc)
        return {min(g) for g in groups.values()}

    # The blocks may miss links near the limit, none that are clearly closer, and never invent one.
    assert first_of_groups(simhash_dedup.NEAR_DISTANCE) <= set(ids(staged[2])) <= first_of_groups(36)
    assert len(ids(staged[2])) - len(first_of_groups(simhash_dedup.NEAR_DISTANCE)) <= 0.02 * len(rows)
    pieces = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, t in rows for w in [t.lower().split()]}
    left = ids(staged[2])
    assert not [(a, b) for a in left for b in left if a < b and len(pieces[a] & pieces[b]) >= 0.9 * len(pieces[a] | pieces[b])]


def test_decontamination_stage(staged, spark, sf):
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    patterns = decontaminate.normal(items)

    def holds(text):
        words = decontaminate.normal([text])
        for i in range(len(items)):
            own = patterns.hash[patterns.first[i] : patterns.last[i]]
            row = decontaminate.edit_rows(words.hash[None, :], own[None, :], np.array([len(own)]), free=True)
            if row.min() <= len(own) // 5:
                return True
        return False

    assert ids(staged[3]) == sorted(r.doc_id for r in staged[2].collect() if not holds(r.text))


def test_mixture_stage(staged):
    before = {}
    for r in staged[3].collect():
        before.setdefault(r.source, []).append(len(brute.words(r.text)))
    after = {}
    for r in staged[4].collect():
        after[r.source] = after.get(r.source, 0) + len(brute.words(r.text))
    want = brute.targets({s: sum(x) for s, x in before.items()})
    assert all(abs(after.get(s, 0) - want[s]) <= max(x) for s, x in before.items())


def test_token_stage(staged):
    from tokenizers import Tokenizer

    rows = [(r.doc_id, r.text) for r in staged[4].collect()]
    assert rows_of(staged[5]) == brute.token_store(rows, Tokenizer.from_file(token_counts.vocabulary_path()))


def test_run_gives_the_last_stage(staged, spark, sf):
    assert rows_of(corpus_pipeline.run(spark, sf)) == rows_of(staged[5])


def test_stages_leave_no_large_files_and_run_keeps_one_stage(spark, sf, tmp_path, monkeypatch):
    from pulsegate.llm import common

    def held():
        return {p.name.rsplit("-", 1)[0]: sum(f.stat().st_size for f in p.glob("part-*")) for p in tmp_path.iterdir()}

    def recorded(df, purpose):
        out = common.store(df, purpose)
        seen.append(sum(held().values()))
        return out

    seen = []
    monkeypatch.setattr(common, "shared_folder", lambda spark, purpose: f"{tmp_path}/{purpose}-{uuid.uuid4().hex}")
    monkeypatch.setattr(simhash_dedup, "store", recorded)
    # Long texts, so that files are larger than their footers.
    dice = random.Random(5)
    rows = [(i, " ".join(f"{dice.randrange(10**6)}" for _ in range(2000))) for i in range(400)]
    rows += [(1000 + i, t.replace(t.split()[7], "new")) for i, t in rows[:20]]
    docs = store(spark.createDataFrame(rows, "doc_id long, text string"), "given")
    size = held()["given"]
    assert ids(simhash_dedup.near_representatives(docs)) == list(range(400))
    # Neither during the search nor after it do its own files take much beside the documents.
    assert max(seen) - size < 0.5 * size
    assert sum(v for k, v in held().items() if k != "given") < 0.05 * size
    assert rows_of(corpus_pipeline.run(spark, sf))
    assert {k for k in held() if k.startswith("stage-")} == {"stage-mixture"}


def test_pipeline_of_edge_cases_and_of_nothing(documents, no_documents, spark, sf):
    for frame in (documents, no_documents):
        docs = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = store(stage(spark, docs, sf), "edge")
            assert docs.columns == frame.columns
        assert corpus_pipeline.tokens(spark, docs, sf).count() == docs.count()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want, got = con.sql(ORACLES[name]), QUERIES[name](spark, sf)
    assert sorted(want.columns) == sorted(got.columns)
    assert rows_of(got, *want.columns) == sorted(want.fetchall(), key=str)


def planted(count, seed):
    """Labelled texts: keys in several forms, and long strings that are none."""
    dice, rows = random.Random(seed), []
    mixed = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    for i in range(count):
        real = i % 2
        if real:
            value = "".join(dice.choices(dice.choice(["0123456789abcdef", mixed]), k=dice.randrange(24, 64)))
            text = f'set {dice.choice(["token", "api_key", "password", "secret"])} {dice.choice("=:")} "{value}" here'
        else:
            value = dice.choice([
                "https://www.example.com/path/to/page" + str(dice.randrange(10**6)) + ".html", "/home/user/project/source/file" + str(i) + ".json",
                str(dice.randrange(10**15, 10**16)), "application-server-module-version-" + str(dice.randrange(10)), "mail" + str(i) + ".example.com.org",
            ])
            text = f"see {dice.choice(['page', 'file', 'number', 'token'])} {value} for more"
        rows.append((i, text, float(real)))
    return rows


def test_forest_on_held_out_findings(spark):
    schema = "doc_id long, text string, label double"
    known, unseen = (spark.createDataFrame(planted(600, s), schema) for s in (1, 2))
    labelled = secret_scan.candidates(known).join(known.select("doc_id", "label"), "doc_id")
    forest = secret_scan.train(secret_scan.with_features(labelled))
    found = secret_scan.score(secret_scan.with_features(secret_scan.candidates(unseen)), forest).join(unseen.select("doc_id", "label"), "doc_id")
    right = found.select(F.avg(((F.col("score") >= 0.5) == (F.col("label") == 1)).cast("int"))).head()[0]
    assert found.count() >= 590 and right > 0.97


def test_scan_of_generated_documents(spark, sf, given):
    import re

    found = secret_scan.scan(spark.read.parquet(f"{sf}/documents.parquet"))
    secrets = {(r.doc_id, r.value) for r in found.filter("secret").collect()}
    assert secrets == {(d, v) for d, t, *_ in given for v in re.findall(r'(?i)token = "([0-9a-f]{40})"', t or "")}


def test_bare_secrets_and_benign_parts_of_words(spark):
    dice, rows = random.Random(4), planted(400, 3)
    hexes, mixed = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    key = lambda letters, k: "".join(dice.choices(letters, k=k))
    known = ["AKIA" + key(mixed[26:], 16), "ghp_" + key(mixed, 36)]
    bare = [key(hexes, 40) for _ in range(20)] + [key(mixed, 40) for _ in range(20)]
    claimed = [key(hexes, 40) for _ in range(20)]
    texts = [f"we found {v} there" for v in known + bare] + [f'the {("latest", "discard")[i % 2]} api_key = "{v}" end' for i, v in enumerate(claimed)]
    found = secret_scan.scan(spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    kept = {r.value for r in found.filter("secret").collect()}
    assert kept >= {*known, *claimed} and len(kept & {*bare}) >= 0.9 * len(bare)
    labels = secret_scan.distant_labels(secret_scan.with_features(found.select("doc_id", "word", "part", "value", "before", "after")))
    label = {r.value: r.label for r in labels.filter("doc_id >= 1000").collect()}
    assert not {*bare} & {*label} and all(label[v] == 1 for v in known + claimed)


def test_every_value_beside_a_credentials_name_is_a_candidate(spark):
    texts = {
        'set password = "Xk9qL2vB" now': {"Xk9qL2vB"}, "the password is hunter2 here": {"hunter2"}, "PASSWORD=P@ss#word!with$igns1 end": {"P@ss#word!with$igns1"},
        "token abcdefghijklmnopqrstuvwxyzabcd end": {"abcdefghijklmnopqrstuvwxyzabcd"}, '{"password":"a,b","token":"c"}': {"a,b", "c"},
        'pwd: "two words, and more" end': {"two words, and more"}, 'secret="two words" end': {"two words"}, "Authorization: Bearer x1 end": {"x1"}, "password: p": {"p"},
        "no name beside Xk9qL2vB": set(), 'api_key => "k1"': {"k1"}, None: set(), "password =": set(),
    }
    rows = [(i, t) for i, t in enumerate(texts)]
    found = {}
    for r in secret_scan.candidates(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found.setdefault(r.doc_id, []).append(r.value)
        assert r.before is not None and r.after is not None
    for (i, _), want in zip(rows, texts.values()):
        assert want <= set(found.get(i, [])) and len(found.get(i, [])) == len(set(found.get(i, []))) and (want or not found.get(i))


def test_scan_of_edge_cases(documents, no_documents):
    assert secret_scan.scan_digest(no_documents).collect() == []
    assert all(r.score in (0, 1) for r in secret_scan.scan_digest(documents).collect())
