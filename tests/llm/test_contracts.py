"""The operators against plain Python versions, on edge cases and on generated documents."""

import pytest
from pyspark.sql import functions as F

from pulsegate.llm import chat_format, decontaminate, line_dedup, mixing, quality_rules, simhash_dedup, substring_dedup, token_counts, token_store
from tests.llm import brute
from tests.llm.conftest import TEXTS, rows_of

SETS = ["edges", "generated"]


@pytest.fixture(params=SETS)
def corpus(request, spark, sf, documents, given):
    return (documents, TEXTS) if request.param == "edges" else (spark.read.parquet(f"{sf}/documents.parquet"), given)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_counts.vocabulary_path())


def test_substring_dedup(corpus, monkeypatch):
    frame, rows = corpus
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 20_000)
    assert rows_of(substring_dedup.repeat_digest(frame)) == brute.substring_dedup(rows)


def test_repeat_spans_match_the_kept_text(documents):
    for row in substring_dedup.remove_repeats(documents).collect():
        assert all(s.begin < s.end for s in row.removed)
        assert row.n_words - sum(s.end - s.begin for s in row.removed) == len(brute.words(row.kept))


def test_token_counts(corpus, tokenizer):
    frame, rows = corpus
    assert rows_of(token_counts.token_digest(frame)) == brute.token_rows(rows, tokenizer)


def test_token_store(corpus, tokenizer):
    frame, rows = corpus
    assert rows_of(token_store.store_digest(frame)) == brute.token_store(rows, tokenizer)


def test_mix(corpus):
    frame, rows = corpus
    found = mixing.mix_digest(frame).collect()
    sizes, largest = {}, {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len(brute.words(text))
        largest[source] = max(largest.get(source, 0), len(brute.words(text)))
    want = brute.targets(sizes)
    source = {(d, len(brute.words(t))): s for d, t, _, s in rows}
    taken = dict.fromkeys(sizes, 0)
    assert len(found) == len(rows)
    for r in found:
        s = source[r.doc_id, r["size"]]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert r.taken <= 3 * r["size"] and (not r["size"] or r.taken % r["size"] == 0)
        taken[s] += r.taken
    # Rows that repeat each other are taken together, so their sizes may come twice.
    assert all(abs(taken[s] - want[s]) <= 2 * largest[s] for s in sizes)
    assert rows_of(mixing.mix_digest(frame.repartition(5))) == sorted(map(tuple, found), key=str)


def test_mixed_documents_keep_their_columns(documents):
    assert mixing.mixed_documents(documents).columns == documents.columns


def test_line_dedup(corpus):
    frame, rows = corpus
    assert rows_of(line_dedup.line_digest(frame)) == brute.line_dedup(rows)


def test_simhash(corpus):
    frame, rows = corpus
    assert rows_of(simhash_dedup.simhash_digest(frame)) == brute.simhash(rows)


def test_pigeonhole_masks_lose_no_pair():
    import numpy as np

    dice = np.random.default_rng(1)
    for nodes in (10, 10**6, 10**9):
        masks = np.array(simhash_dedup.pigeonhole(nodes))[:, 0]
        for _ in range(300):
            flips = dice.choice(64, 4, replace=False)
            difference = np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64))
            assert ((difference & masks) == 0).any()


def test_forest_connects_what_close_pairs_connect():
    import numpy as np

    dice = np.random.default_rng(2)
    for size in (3, 9, 60, 200):
        base = dice.integers(0, 2**63, 3).astype(np.uint64)
        prints = np.array([base[dice.integers(3)] ^ np.bitwise_or.reduce(np.uint64(1) << dice.choice(64, dice.integers(1, 5)).astype(np.uint64)) for _ in range(size)], np.uint64)[:, None]
        pairs = [(i, j) for i in range(size) for j in range(i) if int(prints[i, 0] ^ prints[j, 0]).bit_count() <= 4]
        assert brute.labels(size, pairs) == brute.labels(size, list(zip(*map(list, simhash_dedup.forest(prints, 4)))))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    found = simhash_dedup.components(spark.createDataFrame(edges, "a long, b long"))
    want = [(i, 0) for i in range(41)] + [(i, 100) for i in range(100, 130)] + [(200, 200), (201, 200)]
    assert rows_of(found) == sorted(want, key=str)


def test_near_copies_leave_one(spark):
    words = [f"w{i * i % 8191}" for i in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:200] + ["new"] + words[200:])), (3, " ".join(words).upper()), (4, " ".join(reversed(words)))]
    rows += [(10 + k, " ".join(["x%d" % k if i == 30 + k else w for i, w in enumerate(words)])) for k in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_id", F.lit("other"))
    assert [r.doc_id for r in simhash_dedup.near_representatives(frame).orderBy("doc_id").collect()] == [1, 4]


def test_near_copies_by_exact_similarity(spark):
    import random

    dice, rows = random.Random(8), []
    # Families of pairs around the limit, and one large family whose members are seldom alike enough.
    for family in range(150):
        base = [f"f{family}w{i}" for i in range(100)]
        edits = 1 + family % 6
        rows += [(2 * family, " ".join(base)), (2 * family + 1, " ".join("new" if i % (100 // edits) == 50 // edits and i // (100 // edits) < edits else w for i, w in enumerate(base)))]
    base = [f"h{i}" for i in range(120)]
    for k in range(60):
        gone = set(dice.sample(range(120), 1 + k % 4))
        rows.append((1000 + k, " ".join(f"k{k}" if i in gone else w for i, w in enumerate(base))))
    pieces = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for _, t in rows for w in [t.split()]]
    alike = lambda limit: [(i, j) for i in range(len(rows)) for j in range(i) if len(pieces[i] & pieces[j]) >= limit * len(pieces[i] | pieces[j])]
    firsts = lambda limit: {rows[i][0] for i in brute.labels(len(rows), alike(limit))}
    found = {r.doc_id for r in simhash_dedup.near_representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # Nothing below the limit goes; of the pairs at it the search may miss some, of clearly closer ones none.
    assert firsts(0.8) <= found <= firsts(0.87)
    assert len(found - firsts(0.8)) <= 0.1 * (len(rows) - len(firsts(0.8)))


def test_no_pair_of_sets_is_compared_twice(spark, monkeypatch):
    import random

    dice, base, seen = random.Random(8), [f"h{i}" for i in range(120)], []
    rows = []
    for k in range(60):
        gone = set(dice.sample(range(120), 1 + k % 4))
        rows.append((k, " ".join(f"k{k}" if i in gone else w for i, w in enumerate(base))))
    similar = simhash_dedup.similar

    def recorded(pairs, sets):
        seen.append({(r.a, r.b) for r in pairs.collect()})
        return similar(pairs, sets)

    monkeypatch.setattr(simhash_dedup, "similar", recorded)
    pieces = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for _, t in rows for w in [t.split()]]
    near = [(i, j) for i in range(60) for j in range(i) if len(pieces[i] & pieces[j]) >= 0.8 * len(pieces[i] | pieces[j])]
    found = {r.doc_id for r in simhash_dedup.near_representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found >= {rows[i][0] for i in brute.labels(60, near)}
    assert len(seen) > 1 and sum(map(len, seen)) == len(set().union(*seen))


def test_proposals_connect_what_links_connect():
    import numpy as np

    dice = np.random.default_rng(9)
    for trust in (46, 30, -1):
        base = dice.integers(0, 2**63, (3, 4)).astype(np.uint64)
        prints = np.array([base[dice.integers(3)] ^ np.packbits(dice.random(256) < dice.choice([0.03, 0.08, 0.12]), bitorder="little").view("<u8") for _ in range(80)])
        near = [(i, j) for i in range(80) for j in range(i) if simhash_dedup.distances(prints[i], prints[j]) <= 46]
        a, b, trusted = simhash_dedup.proposals(prints, np.arange(80), 46, trust)
        assert brute.labels(80, near) == brute.labels(80, list(zip(a.tolist(), b.tolist())))
        assert trust >= 0 or {(max(p), min(p)) for p in zip(a.tolist(), b.tolist())} == set(near) and not trusted.any()


ITEMS = [(1, " ".join(f"term{i * 7 % 101}" for i in range(40))), (2, "A few, short words are in it."), (3, None), (4, ""), (None, "no id here"), (1, " ".join(f"term{i * 7 % 101}" for i in range(40)))]


def test_leaks_are_found_with_edits_and_without(spark):
    item = ITEMS[0][1].split()
    edited = [*item[:5], "new", *item[6:20], *item[21:30], "put", "in", *item[30:]]
    rows = [
        (0, "before " + " ".join(item) + " after"), (1, "Before it: " + ", ".join(edited).upper() + " ..."), (2, " ".join(item[:20])), (3, None), (4, ""),
        (5, "we say a few short\nwords are in it"), (6, " ".join(reversed(item))), (None, " ".join(item)), (7, ("filler text " * 30_000) + " ".join(item)),
    ]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    documents = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_hits", F.lit(1)).withColumn("item_id", F.lit(9))
    found = rows_of(decontaminate.leaks(documents, items).distinct())
    assert found == sorted([(0, 1, 0, 1, 41), (1, 1, 4, 2, 43), (5, 2, 0, 2, 9), (None, 1, 0, 0, 40), (7, 1, 0, 60_000, 60_040)], key=str)
    clean = decontaminate.clean_documents(documents, items)
    assert clean.columns == documents.columns and sorted(r.doc_id for r in clean.collect()) == [2, 3, 4, 6]
    assert decontaminate.clean_documents(documents, items.limit(0)).count() == len(rows)


def test_leaks_of_whole_passages_are_all_found(spark, sf, given):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.read.parquet(f"{sf}/documents.parquet"), items).collect()}
    plain = lambda x: " ".join((x or "").lower().split())
    assert found >= {(d, r.item_id) for r in items.collect() for d, text, *_ in given if plain(r.text) in plain(text)}


def test_recall_at_the_most_edits():
    import random

    dice = random.Random(3)
    words = [f"{dice.randrange(10**6):06d}"[: dice.randrange(2, 7)] for _ in range(3000)]
    items = [" ".join(dice.choices(words, k=dice.randrange(8, 70))) for _ in range(120)]
    index, found = decontaminate.Index(list(range(len(items))), items), 0
    for number, item in enumerate(items):
        text = item.split()
        for place in sorted(dice.sample(range(len(text)), len(text) // 5), reverse=True):
            kind = dice.randrange(3)
            text[place : place + (kind != 1)] = [] if kind == 2 else ["changed"]
        hits = index.hits([" ".join(dice.choices(words, k=50) + text + dice.choices(words, k=50))])[0]
        found += number in [h[0] for h in hits]
    assert found >= 0.9 * len(items)


@pytest.mark.parametrize("where", [0.0, 0.4, 0.8])
@pytest.mark.parametrize("kind", ["changed", "left out", "put in"])
def test_no_item_is_missed_wherever_its_edits_are(where, kind):
    import random

    dice = random.Random(5)
    words = [f"{dice.randrange(10**6):06d}"[: dice.randrange(2, 7)] for _ in range(3000)]
    items = [dice.choices(words, k=k) for k in range(1, 90)]
    index = decontaminate.Index(list(range(len(items))), [" ".join(x) for x in items])
    for number, item in enumerate(items):
        edits, at = len(item) // 5, int(where * len(item))
        new = [f"new{i}" for i in range(edits)] if kind != "left out" else []
        text = dice.choices(words, k=50) + item[:at] + new + item[at + (edits if kind != "put in" else 0) :] + dice.choices(words, k=50)
        assert [h[1] for h in index.hits([" ".join(text)])[0] if h[0] == number][:1] <= [edits]
        assert number in [h[0] for h in index.hits([" ".join(text)])[0]]


def test_items_of_few_different_words_equal_brute_force():
    import numpy as np

    dice = np.random.default_rng(6)
    draw = lambda k: " ".join(f"w{x}" for x in dice.integers(0, 3, k))
    items, texts = [draw(k) for k in range(1, 24)], [draw(dice.integers(1, 60)) for _ in range(40)]
    patterns = decontaminate.normal(items)
    found = [{(h[0], h[1]) for h in x} for x in decontaminate.Index(list(range(len(items))), items).hits(texts)]
    for text, own in zip(texts, found):
        words, want = decontaminate.normal([text]).hash[None, :], set()
        for i in range(len(items)):
            pattern = patterns.hash[patterns.first[i] : patterns.last[i]]
            least = int(decontaminate.edit_rows(words, pattern[None, :], np.array([len(pattern)]), free=True).min())
            want |= {(i, least)} if least <= len(pattern) // 5 else set()
        assert own == want


def test_edit_rows_equal_the_plain_distance():
    import numpy as np

    dice = np.random.default_rng(4)
    for _ in range(40):
        text, item = dice.integers(0, 4, dice.integers(1, 12)).astype(np.uint64), dice.integers(0, 4, dice.integers(1, 9)).astype(np.uint64)
        row = decontaminate.edit_rows(text[None, :], item[None, :], np.array([len(item)]), free=False)[0]
        assert row.tolist() == [brute.edits(item.tolist(), text[:j].tolist()) for j in range(len(text) + 1)]


def test_quality_numbers(corpus):
    frame, rows = corpus
    found = quality_rules.quality_digest(frame)
    assert rows_of(found.drop("kept")) == brute.quality_base(rows)
    assert not [r for r in found.collect() if r.kept and r.base_failed]


def test_quality_verdicts_agree_with_labels(spark, sf):
    kept = quality_rules.quality_digest(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    share = {r.quality: r.share for r in kept.filter("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert share[1] > 0.98 and share.get(0, 0) < 0.1


def test_kept_documents_keep_their_columns(documents):
    assert quality_rules.kept_documents(documents).columns == documents.columns


CHATS = [
    (1, 0, "system", "be [INST] nice \\ \\\\"), (1, 2, "assistant", "</s></s>"), (1, 1, "user", "\\[/INST]\\"),
    (2, None, "user", None), (2, 1, None, ""), (2, 1, "assistant", "x\0\\\\\0y"), (2, 1, "assistant", "x\0\\\\\0y"),
    (None, 3, "tool", "<<SYS>><</SYS>>"), (None, 0, "user", "<<s>"), (3, 0, "user", "a" * 200_000 + "[INST]"),
]


def test_chats(spark):
    frame = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").withColumn("valid", F.lit(1))
    own = [(-1, 0, "user", chat_format.HOSTILE), (-1, 1, "assistant", chat_format.HOSTILE)]
    assert rows_of(chat_format.chat_digest(frame).drop("formatted_chars", "valid")) == brute.chats(CHATS + own)
    valid = {r.conv_id: r.valid for r in chat_format.chat_digest(frame).collect()}
    assert valid == {-1: True, 1: True, 2: False, None: False, 3: True}


def test_formatted_texts_hold_no_control_string(spark):
    frame = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string")
    template = chat_format.Template()
    for row in chat_format.format_chats(frame).collect():
        assert not any(c in row.body for c in template.controls)


def test_empty_tables(no_documents, spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    for frame in (
        substring_dedup.repeat_digest(no_documents), token_counts.token_digest(no_documents), token_store.store_digest(no_documents),
        mixing.mix_digest(no_documents), line_dedup.line_digest(no_documents), quality_rules.quality_digest(no_documents), simhash_dedup.simhash_digest(no_documents),
    ):
        assert frame.collect() == []
    assert [r.conv_id for r in chat_format.chat_digest(none).collect()] == [-1]


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_planes_round_trip(kind):
    import numpy as np

    for n in (0, 1, 7, 8, 9, 70_001):
        ids = np.random.default_rng(n).integers(0, 50_257, n).astype(np.uint32)
        width, planes, sizes = token_store.pack(ids, kind)
        assert (token_store.unpack(planes, sizes, n, kind, width) == ids).all()


def test_lexicon_finds_each_pretoken(monkeypatch):
    """Numbers of pre-tokens in batches, with crowded tables, equal hashes and a fresh start in between."""
    import random

    from pulsegate.llm import pretokens

    monkeypatch.setattr(pretokens.Lexicon, "SLOTS", 64)
    for clash in (False, True):
        if clash:
            monkeypatch.setattr(pretokens.Lexicon, "_hash", lambda self, codes, begin, end: (end - begin).astype("uint64") + 1)
        rng = random.Random(5)
        lexicon, known = pretokens.Lexicon(), []
        for _ in range(6):
            texts = ["".join(rng.choice("ab \n1é\U0001f600'") for _ in range(rng.randrange(40))) for _ in range(50)] + [""]
            joined, codes, cuts, counts = pretokens.codes_of(texts)
            numbers, fresh = lexicon.numbers(joined, codes, cuts)
            known += fresh
            words, sizes = pretokens.split_texts(texts)
            assert [known[i] for i in numbers] == words and counts.tolist() == sizes.tolist()
        assert len(known) == len(set(known))


def test_pretokens_encoded_together(tokenizer):
    """The library sees the same pre-tokens side by side as alone."""
    from pulsegate.llm.token_store import Encoder

    words = [" a", "b", " 's", "'s", "'ll", "\n", "  ", " \t", "12", " 12", "é", " ½", "!?", " !?", "　", " 　", "x" * 400, "a\x1c", "\x1c", " \x1c", " ça", "\U0001f600", "‍", " ‍́"]
    encoder = Encoder(token_counts.vocabulary_path())
    ids, counts = encoder._each(words)
    ends = counts.cumsum()
    for word, n, end in zip(words, counts, ends):
        assert ids[end - n : end].tolist() == tokenizer.encode(word, add_special_tokens=False).ids, word


def test_items_without_an_id_are_looked_for(spark):
    item = " ".join(f"word{i}" for i in range(40))
    items = spark.createDataFrame([(None, item), (1, " ".join(f"other{i}" for i in range(40))), (None, None)], "item_id long, text string")
    documents = spark.createDataFrame([(1, "before " + item + " after"), (2, "nothing of it")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.leaks(documents, items).collect()] == [(1, None)]
    assert [r.doc_id for r in decontaminate.clean_documents(documents, items).collect()] == [2]


def test_mix_keeps_columns_of_any_name(spark):
    rows = [(i, f"some words of text {i} " * (1 + i % 5), "ab"[i % 2], i * 10, i * 100, "x") for i in range(60)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string, _copy int, _mix int, _doc string")
    mixed = mixing.mixed_documents(documents)
    assert mixed.columns == documents.columns
    assert all((r._copy, r._mix, r._doc) == (r.doc_id * 10, r.doc_id * 100, "x") for r in mixed.collect()) and mixed.count() > 0
    assert mixing.mix(documents).columns == ["doc_id", "text", "source", "_copy", "_doc", "_mix"]


def test_workers_give_back_what_batches_took(monkeypatch):
    import re
    import time

    import pyarrow as pa

    from pulsegate.llm import pretokens

    def held():
        return int(re.search(r"RssAnon:\s+(\d+)", open("/proc/self/status").read())[1]) / 1024

    monkeypatch.setattr(pretokens, "IDLE_SECONDS", 0.3)

    @pretokens.lent
    def each(batches):
        for batch in batches:
            yield sum(len(x) for x in [pa.array([bytes(2000)] * 100) for _ in range(batch)])

    before = held()
    assert list(each([500, 500])) == [50_000, 50_000]
    time.sleep(1.0)
    assert held() - before < 30


def test_sets_of_proposed_pairs_come_once(spark):
    from pulsegate.llm.common import store

    rows = [(i, " ".join(f"w{(i * 7 + k) % 50}" for k in range(12))) for i in range(600)]
    for more in ([], rows[:3] * 4):
        prints = store(simhash_dedup.with_shingle_sets(spark.createDataFrame(rows + more, "doc_id long, text string")), "sets")
        wanted = store(prints.filter("id < 40").select("node", "id", "text_key").distinct(), "wanted")
        before = {p.id for p in prints.filter("id < 40").select("id").distinct().collect()}
        found = simhash_dedup.sets_of(prints, wanted)
        assert found.count() == wanted.count() == len(before) == 40
        want = {(r.id, tuple(r.pieces)) for r in prints.filter("id < 40").collect()}
        assert {(r.id, tuple(r.pieces)) for r in found.join(wanted, "node").collect()} >= want


def test_workers_forget_when_idle(monkeypatch):
    import time

    from pulsegate.llm import pretokens

    monkeypatch.setattr(pretokens, "IDLE_SECONDS", 0.3)
    with pretokens.at_work() as state:
        state["kept"] = 1
        time.sleep(0.6)
        assert pretokens.worker_state()["kept"] == 1
    for _ in range(3):
        time.sleep(0.1)
        with pretokens.at_work() as state:
            assert state["kept"] == 1
    time.sleep(1.0)
    assert "kept" not in pretokens.worker_state()
