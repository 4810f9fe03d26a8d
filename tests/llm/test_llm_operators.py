import itertools
import math
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.llm import cooccurrence, language, near_duplicates, packing, reading_level, repeated_lines, tokenizer, wrapper

needs_vocabulary = pytest.mark.skipif(not os.path.exists(tokenizer.rank_path()), reason="no vocabulary files")


# ---- co-occurrence


def test_pairs_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", " A", "b", "c", "d", "", "nan", None, "e "])) for i in range(60) for _ in range(3)]
    rows += rows[:20] + [(None, "a")]
    df = spark.createDataFrame(rows, "id int, item string").withColumn("kind", F.lit("clash")).withColumn("items", F.lit("clash"))
    records = cooccurrence.item_records(df, kind="k", record="id", item=F.col("item"))
    sets = {}
    for i, x in rows:
        x = (x or "").strip().lower()
        if i is not None and x not in ("", "nan"):
            sets.setdefault(i, set()).add(x)
    n = len(sets)
    got = {(r.item_1, r.item_2): r for r in cooccurrence.cooccurrence(records).collect()}
    for a, b in itertools.combinations(sorted(set().union(*sets.values())), 2):
        n12 = sum(a in s and b in s for s in sets.values())
        n1, n2 = sum(a in s for s in sets.values()), sum(b in s for s in sets.values())
        if not n12:
            assert (a, b) not in got
            continue
        r = got[(a, b)]
        assert (r.n12, r.n1, r.n2, r.n) == (n12, n1, n2, n)
        cells = [(n12, n1, n2), (n1 - n12, n1, n - n2), (n2 - n12, n - n1, n2), (n - n1 - n2 + n12, n - n1, n - n2)]
        assert r.llr == pytest.approx(2 * sum(k * math.log(k * n / (x * y)) for k, x, y in cells if k), abs=1e-9)
    assert cooccurrence.cooccurrence(records.limit(0)).count() == 0


def test_hot_items_are_merged_whole(spark, monkeypatch):
    monkeypatch.setattr(cooccurrence, "ENTRIES_IN_MEMORY", 50)
    rows = [("k", i, sorted({"hot", f"x{i % 90}", f"y{i % 7}"})) for i in range(3000)]
    df = spark.createDataFrame(rows, "kind string, record int, items array<string>").repartition(5)
    got = {(r.item_1, r.item_2): (r.n12, r.n1, r.n2, r.n) for r in cooccurrence.cooccurrence(df).collect()}
    assert len(got) == 90 + 7 + 90 * 7 and got["hot", "x4"] == (34, 3000, 34, 3000) and got["hot", "y0"][0] == sum(i % 7 == 0 for i in range(3000))


@settings(max_examples=300, deadline=None)
@given(st.integers(8, 500), st.integers(0, 2000), st.integers(0, 2000), st.integers(0, 10**6))
def test_significance_takes_no_case_of_the_default_lift(n12, more_1, more_2, rest):
    n1, n2 = n12 + more_1, n12 + more_2
    n = n1 + n2 - n12 + rest
    if n12 * n >= 2.5 * n1 * n2:
        cells = [(n12, n1, n2), (n1 - n12, n1, n - n2), (n2 - n12, n - n1, n2), (n - n1 - n2 + n12, n - n1, n - n2)]
        assert 2 * sum(k * math.log(k * n / (x * y)) for k, x, y in cells if k) >= 5.06


# ---- repeated lines


def articles(spark, rows):
    return spark.createDataFrame(rows, "document_id string, final_url string, body string, paragraphs array<string>").withColumn("site", F.lit("clash")).withColumn("line_no", F.lit(0))


def test_repeated_lines(spark):
    rows = [(f"d{i}", f"https://www.A.example/{i}", f"Share  12 \xa0times\r\n\nOnly {chr(97 + i)} here\nshare 3 times\nFoot", ["SHARE 9 times", "Only"]) for i in range(8)]
    rows += [(f"e{i}", f"http://b.example/{i}", "share 1 times\nother", None) for i in range(7)]
    rows += [rows[0], ("n", "http://a.example/n", None, None), (None, None, "share 1 times", None), ("z", None, "", [])]
    df = articles(spark, rows)
    got = {tuple(r) for r in repeated_lines.repeated_occurrences(df).select("document_id", "line_no").collect()}
    assert got == {(f"d{i}", k) for i in range(8) for k in (1, 4, 5)}
    seqs = {(r.length, r.documents) for r in repeated_lines.frequent_sequences(df, max_length=4).collect()}
    assert seqs == {(1, 8), (2, 8), (3, 8)}
    clean = {r.document_id: r for r in repeated_lines.without_repeated_lines(df).collect()}
    assert clean["d0"].body == "\nOnly a here" and clean["d0"].paragraphs == ["Only"] and clean["d0"].n_removed_lines == 3 and clean["d0"].n_removed_paragraphs == 1
    assert clean["n"].body is None and clean["e0"].body == "share 1 times\nother" and clean["z"].body == ""
    assert repeated_lines.repeated_occurrences(df.limit(0)).count() == 0


def test_long_frequent_sequences_are_whole(spark):
    foot = [f"foot {chr(97 + k)}" for k in range(10)]
    rows = [(f"d{i}", f"http://a.example/{i}", "\n".join([f"only {chr(97 + i)}", *foot]), None) for i in range(8)]
    rows += [(f"s{i}", f"http://a.example/s{i}", "\n".join(foot[:3]), None) for i in range(2)]
    got = sorted((r.length, r.documents, r.occurrences) for r in repeated_lines.frequent_sequences(articles(spark, rows)).collect())
    assert got == sorted((k, n, n) for k in range(1, 11) for n in [10 if s + k <= 3 else 8 for s in range(11 - k)])
    assert repeated_lines.frequent_sequences(articles(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("max_gap", [0, 1, None])
def test_frequent_sequences_against_brute_force(spark, max_gap):
    rng = random.Random(8)
    documents = [[rng.choice("abcdx") * 2 for _ in range(rng.randrange(1, 8))] for _ in range(14)]
    rows = [(f"d{i}", "http://a.example/", "\n".join(lines), None) for i, lines in enumerate(documents)]
    df = articles(spark, rows)
    single = {x for x in "abcdx" if sum(x * 2 in d for d in documents) >= 4}
    want: dict[tuple, set] = {}
    for i, lines in enumerate(documents):
        kept = [x[0] for x in lines if x[0] in single]
        for n in range(1, len(kept) + 1):
            for at in itertools.combinations(range(len(kept)), n):
                if max_gap is None or all(b - a <= max_gap + 1 for a, b in zip(at, at[1:])):
                    want.setdefault(tuple(kept[k] for k in at), set()).add((i, at[-1]))
    want = {p: (len({i for i, _ in w}), len(w)) for p, w in want.items() if len({i for i, _ in w}) >= 4}
    names = {r.id: r.key[0] for r in repeated_lines.line_names(df).collect()}
    got = repeated_lines.frequent_sequences(df, min_documents=4, max_gap=max_gap).collect()
    assert {tuple(names[x] for x in r.pattern): (r.documents, r.occurrences) for r in got} == want and len(got) == len(want)


# ---- tokenizer


@needs_vocabulary
@settings(max_examples=200, deadline=None)
@given(st.text(max_size=300) | st.text(alphabet="ab1 \n\t'.,é字😀 ", max_size=400), st.integers(5, 60))
def test_pieces_have_the_ids_of_the_whole(text, size):
    path = tokenizer.rank_path()
    text = text.encode("utf-8", "ignore").decode()
    whole = tokenizer.encoding(path).encode_ordinary(text)
    assert "".join(tokenizer.pieces(text, size)) == text
    assert tokenizer.encode(text, path, size) == whole
    assert tokenizer.decode(whole, path) == text.encode()


@needs_vocabulary
def test_ids_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "<|endoftext|>"), (5, "word " * 40_000), (6, "x" * 200_000), (6, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("ids", F.lit("clash"))
    out = tokenizer.token_ids(df).collect()
    assert len(out) == len(rows)
    enc = tokenizer.encoding(tokenizer.rank_path())
    want = sorted((i, enc.encode_ordinary(t or "")) for i, t in rows)
    assert sorted((r.doc_id, list(r.ids)) for r in out) == want
    counts = sorted((r.doc_id, r.n_tokens) for r in tokenizer.token_counts(df).collect())
    assert counts == sorted((i, len(x)) for i, x in want)
    assert tokenizer.token_ids(df.limit(0)).count() == 0


# ---- containers


def check_containers(rows, sizes, capacity):
    used, parts = {}, {}
    for r in rows:
        used[r.container_id] = used.get(r.container_id, 0) + r.n_tokens
        parts.setdefault(r.item, []).append((r.part, r.first_token, r.n_tokens))
    assert max(used.values(), default=0) <= capacity
    assert set(parts) == set(sizes)
    for item, p in parts.items():
        p.sort()
        assert [x[0] for x in p] == list(range(len(p))) and sum(x[2] for x in p) == sizes[item]
        assert all(b[1] == a[1] + a[2] for a, b in zip(p, p[1:]))
        assert len(p) == max(1, -(-sizes[item] // capacity))
    return used


def test_containers_hold_each_item_once(spark):
    rng = random.Random(5)
    sizes = {str(i): int(min(9000, rng.lognormvariate(5, 1.2))) for i in range(4000)} | {"zero": 0, "null": 0, "full": 2048, "two": 4096}
    rows = [(k, None if k == "null" else v) for k, v in sizes.items()]
    df = spark.createDataFrame(rows, "item string, size long").withColumn("part", F.lit("clash")).repartition(6)
    out = packing.fill_containers(df, item="item", size="size", capacity=2048).collect()
    used = check_containers(out, sizes, 2048)
    assert len(used) <= 1.02 * sum(sizes.values()) / 2048 + 1
    assert packing.fill_containers(df.limit(0), item="item", size="size").count() == 0


def test_any_number_of_items_without_size(spark, monkeypatch):
    monkeypatch.setattr(packing, "HELD", 50)
    empty = spark.range(5000).select(F.concat(F.lit("e"), "id").alias("item"), F.lit(0).cast("long").alias("size"))
    assert len({r.container_id for r in packing.fill_containers(empty.repartition(3), item="item", size="size").collect()}) == 3
    some = empty.unionByName(spark.range(40).select(F.concat(F.lit("s"), "id").alias("item"), F.lit(500).cast("long").alias("size"))).repartition(4)
    out = packing.fill_containers(some, item="item", size="size", capacity=1000).collect()
    used = check_containers(out, {**{f"e{i}": 0 for i in range(5000)}, **{f"s{i}": 500 for i in range(40)}}, 1000)
    assert len(out) == 5040 and len(used) <= 24


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=200), st.integers(1, 8))
def test_best_fit_keeps_its_bounds(sizes, limit):
    p, closed = packing.BestFit(50, limit), []
    for i, s in enumerate(sizes):
        closed += p.add(s, (i, s))
        assert p.count <= limit
    closed += [b for _, b in p.rest()]
    assert sorted(x[0] for b in closed for x in b) == list(range(len(sizes)))
    assert all(sum(x[1] for x in b) <= 50 for b in closed)


# ---- near-duplicates


def test_links_against_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = {}
    for i in range(40):
        base = [rng.choice(vocabulary) for _ in range(80)]
        texts[f"{i:03d}a"] = " ".join(base)
        for j in range(rng.randrange(4)):
            edit = list(base)
            for _ in range(j * 2):
                edit[rng.randrange(80)] = rng.choice(vocabulary)
            texts[f"{i:03d}b{j}"] = " ".join(edit)
    rows = [*texts.items(), *list(texts.items())[:5], ("null", None), ("empty", ""), ("short", "two words"), (None, "x y z")]
    df = spark.createDataFrame(rows, "id string, text string").withColumn("bands", F.lit("clash"))
    members, links = near_duplicates.near_duplicates(df, record="id", text="text")

    def shingles(t):
        w = t.split()
        return {tuple(w[k : k + 3]) for k in range(len(w) - 2)}

    sets = {k: shingles(t) for k, t in texts.items()}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    assert {tuple(r) for r in near_duplicates.linked_records(members, links).collect()} == want
    star = [tuple(r) for r in near_duplicates.linked_records(members, links, copies="star").collect()]
    assert set(star) <= want and len(star) == len(set(star)) and {x for p in star for x in p} == {x for p in want for x in p}
    for block in (1, 2, 3):
        in_blocks = near_duplicates.near_duplicates(df, record="id", text="text", block=block)
        pairs = [tuple(r) for r in near_duplicates.linked_records(*in_blocks, block=block).collect()]
        assert set(pairs) == want and len(pairs) == len(want)
        assert {(r.id_1, r.id_2): round(r.jaccard, 9) for r in in_blocks[1].collect()} == {(r.id_1, r.id_2): round(r.jaccard, 9) for r in links.collect()}
    classes = {r.id: r for r in near_duplicates.classes_with_links(members, links).collect()}
    assert set(classes) == set(texts) and all(texts[r.class_id] == texts[k] for k, r in classes.items())
    empty = near_duplicates.near_duplicates(df.limit(0), record="id", text="text")
    assert empty[0].count() == 0 and empty[1].count() == 0


def test_pairs_of_a_hot_group_are_whole(spark):
    df = spark.createDataFrame([("k", f"{i:03d}", i) for i in range(50)] + [("l", "a", 1), ("l", "b", 2), ("m", "c", 3)], "key string, id string, size int")
    for block in (1, 7, 49, 1000):
        got = [tuple(r) for r in near_duplicates.pairs_within(df, "key", block=block).collect()]
        want = {(f"{i:03d}", f"{j:03d}", i, j) for i in range(50) for j in range(i + 1, 50)} | {("a", "b", 1, 2)}
        assert len(got) == len(want) and {(r[0], r[2], r[1], r[3]) if isinstance(r[1], int) else r for r in got} == want


def test_large_disjoint_sets_have_no_common_coordinates():
    rng = np.random.default_rng(2)
    x, y = (np.unique(rng.integers(-(2**63), 2**63 - 1, 300_000)) for _ in range(2))
    assert (near_duplicates.signature(x) == near_duplicates.signature(y)).mean() <= 0.01
    assert len(np.unique(near_duplicates.permuted(np.arange(100_000, dtype=np.uint32), near_duplicates.PI))) == 100_000


def test_circulant_signature_estimates_jaccard():
    rng = np.random.default_rng(1)
    a = rng.integers(-(2**63), 2**63 - 1, 600)
    x, y = a[:500], a[100:]
    k = 2048
    same = (near_duplicates.signature(np.unique(x), k) == near_duplicates.signature(np.unique(y), k)).mean()
    assert abs(same - 400 / 600) < 0.05


# ---- page furniture


def pages(n=180):
    rng = random.Random(11)
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100]}" for i in range(600)]
    out = []
    for i in range(n):
        host = "one.example" if i % 3 else "two.example"
        body = [" ".join(rng.choice(words) for _ in range(30)).capitalize() + "." for _ in range(4)]
        if i % 30 < 3:  # a subheading, at the same rate on both hosts
            body.insert(2, "The wider view")
        if host == "one.example":
            lines = ["Home | News | About", "By Ann Other", body[0], "Advertisement", *body[1:], "Share this page", f"{i} comments", "© 2020 One"]
            gone = {1, 2, 4, len(lines) - 2, len(lines) - 1, len(lines)}
        else:
            lines = ["Menu", *body, "Back to top"]
            gone = {1, len(lines)}
        out.append((f"d{i}", f"https://www.{host}/{i}", "\n".join(lines), gone))
    return out


def test_furniture_lines(spark):
    rows = pages()
    df = articles(spark, [(*r[:3], None) for r in rows] + [(*rows[0][:3], None), ("n", "https://one.example/n", None, None), ("blank", "https://one.example/b", " \n\n", None), (None, None, "Menu", None)])
    labels = wrapper.label_lines(df).collect()
    got = {(r.document_id, r.line_no) for r in labels if r.furniture}
    want = {(r[0], k) for r in rows for k in r[3]}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
    assert {r.document_id for r in labels} == {r[0] for r in rows}
    text = {r.document_id: r.text for r in wrapper.main_text(df).collect()}
    assert set(text) == {r[0] for r in rows} | {"blank"} and "Menu" not in text["d0"] and text["d0"].count("\n") == 4 and "The wider view" in text["d0"]
    assert wrapper.label_lines(df.limit(0)).count() == 0 and wrapper.main_text(df.limit(0)).count() == 0


def test_wrapper_folds_mismatches_into_groups_and_slots():
    a, b, c, t, f = 100, 200, 300, wrapper.TEXT, wrapper.FREE
    w = wrapper.Wrapper()
    for stream in ([a, t, b], [a, t, c, t, b], [a, f, t, b, b], [a, t, b]):
        w.fold(wrapper.Wrapper.of_page(stream, [0] * len(stream)))
    names = {a: "A", b: "B", c: "C"}
    assert w.pages == 4 and w.expression(names.get) == "(A) (TEXT+)? (LINE+)? (C)? (TEXT+)? (B)+"
    repeated = wrapper.collapsed([a, b, a, b, a, b, c])
    assert [(x[0], x[1]) for x in repeated] == [(a, True), (b, True), (c, False)] and repeated[0][2] == [0, 2, 4]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from([1, 2, 100, 200, 300, 400]), max_size=12), min_size=1, max_size=8))
def test_wrapper_matches_every_page_it_was_folded_from(streams):
    parts = [wrapper.Wrapper(), wrapper.Wrapper()]
    for i, stream in enumerate(streams):
        parts[i % 2].fold(wrapper.Wrapper.of_page(stream, [0] * len(stream)))
    whole = wrapper.Wrapper()
    for p in parts:
        whole.fold(p)
    assert whole.pages == len(streams) and len(whole.slots) == len(whole.elements) + 1
    back = wrapper._from_rows(dict(zip(wrapper._ELEMENT_SCHEMA.names, r)) for r in wrapper._to_rows("s", 0, whole))
    assert back.expression() == whole.expression()
    for stream in streams:
        symbols = [s for s, _, _ in wrapper.collapsed(stream) if s > 2]
        places = whole.align(symbols)
        assert all(whole.elements[p].symbol == s for s, p in zip(symbols, places) if p >= 0)
        assert [p for p in places if p >= 0] == sorted({p for p in places if p >= 0})
    assert sum(e.pages for e in whole.elements) == sum(1 for s in streams for x in wrapper.collapsed(s) if x[0] > 2)


@pytest.mark.parametrize("others", [0, 3_000, 70_000])
def test_labels_of_a_small_host_do_not_depend_on_other_hosts(spark, others):
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice("abcdefghij") * rng.randrange(2, 9) for _ in range(30)) + "."
    rows = [(f"s{i}", f"https://small.example/{i}", "\n".join(["Start | Map", text(), text(), "Write to the editor", "All of it is free"]), None) for i in range(12)]
    df = articles(spark, rows)
    if others:
        words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(25)), lambda k: F.concat(F.lit("w"), F.translate(F.conv((F.xxhash64("id", k) % 997).cast("string"), 10, 16), "0123456789", "ghijklmnop"))), " ")
        more = spark.range(others).select(F.format_string("o%d", "id").alias("document_id"), F.format_string("http://h%d.example/%d", F.col("id") % 9, "id").alias("final_url"), F.concat(F.lit("Other menu\n"), words, F.lit(".\nOther foot")).alias("body"), F.lit(None).cast("array<string>").alias("paragraphs"))
        df = df.unionByName(more.withColumn("site", F.lit("clash")).withColumn("line_no", F.lit(0)))
    got = {(r.document_id, r.line_no) for r in wrapper.label_lines(df).filter("furniture and document_id like 's%'").collect()}
    assert got == {(f"s{i}", k) for i in range(12) for k in (1, 4, 5)}


def test_wrappers_do_not_depend_on_the_partitioning(spark):
    rows = pages(90)
    df = articles(spark, [(*r[:3], None) for r in rows])
    one, many = (sorted(map(tuple, wrapper.host_wrappers(df.repartition(n)).collect()), key=str) for n in (1, 7))
    assert one == many and {r[0] for r in one} == {"one.example", "two.example"}
    foot = [r for r in one if r[0] == "one.example" and r[3] is not None][-1]
    assert foot[4] == 60 and not foot[5] and foot[7] == 0.0


# ---- reading level


def test_reading_level_on_held_out_texts(spark):
    rng = random.Random(4)
    pools = {1: ["cat", "sun", "ran", "the", "big"], 2: ["garden", "bridge", "window", "people"], 3: ["committee", "proposal", "agreement", "decided"], 4: ["epistemological", "jurisdictional", "intergovernmental", "notwithstanding"]}
    rows, labels = [], []
    for i in range(240):
        band = i % 4 + 1
        words = [rng.choice(pools[band] + pools[max(1, band - 1)]) for _ in range(100)]
        rows.append((f"d{i}", ". ".join(" ".join(words[k : k + 5 * band]) for k in range(0, 100, 5 * band)) + "."))
        if i < 160:
            labels.append((f"d{i}", band))
    labels += [labels[0], ("gone", 2), (None, 1), ("d1", None)]
    texts = spark.createDataFrame(rows + [("short", "too few words"), ("null", None), ("empty", "")], "document_id string, text string").withColumn("x", F.lit("clash"))
    marks = spark.createDataFrame(labels, "document_id string, band int").withColumn("x", F.lit("clash"))
    got = {r.id: r.band for r in reading_level.reading_levels(texts, marks, record="document_id", text="text").collect()}
    assert set(got) == {r[0] for r in rows}
    held = [i for i in range(160, 240)]
    assert sum(got[f"d{i}"] == i % 4 + 1 for i in held) >= 0.9 * len(held)
    assert reading_level.reading_levels(texts, marks.limit(0), record="document_id", text="text").count() == 0
    assert reading_level.reading_levels(texts.limit(0), marks, record="document_id", text="text").count() == 0


def test_calibration_on_texts_left_out():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 5))
    score = x @ np.array([2.0, -1.0, 0.5, 0.0, 0.0]) + rng.logistic(size=900)
    y = np.digitize(score, [-1.5, 0.0, 1.5]) + 1
    fit, held = slice(0, 600), slice(600, 900)
    plain, model = reading_level.fit_ordinal(x[fit], y[fit]), reading_level.calibrated(x[fit], y[fit])
    assert list(model.cuts) == sorted(model.cuts) and (model.predict(x[held]) == y[held]).mean() >= (plain.predict(x[held]) == y[held]).mean() - 0.02
    below = 1 / (1 + np.exp(-(model.cuts[None, :] - ((x[held] - model.mean) / model.scale @ model.weights)[:, None])))
    assert np.abs(below.mean(axis=0) - [(y[held] <= k).mean() for k in (1, 2, 3)]).max() < 0.06
    assert reading_level.calibrated(x[:4], np.array([1, 2, 3, 4])).bands == [1, 2, 3, 4]


# ---- language

SAMPLES = {
    "en": "the council has decided that the new school will be built near the old station and the people who live there are glad about it",
    "fr": "le conseil a décidé que la nouvelle école sera construite près de la vieille gare et les gens qui y habitent en sont contents",
    "de": "der rat hat beschlossen dass die neue schule in der nähe des alten bahnhofs gebaut wird und die leute die dort wohnen freuen sich darüber",
    "es": "el consejo ha decidido que la nueva escuela se construirá cerca de la vieja estación y la gente que vive allí está contenta",
}


def test_language_of_documents_and_lines(spark):
    train = [(k, v) for k, v in SAMPLES.items() for _ in range(3)]
    profiles = language.fit_profiles(train)
    rows = [
        (1, "en", SAMPLES["en"]), (2, "EN-gb", SAMPLES["en"]), (3, "French", SAMPLES["en"]), (4, None, SAMPLES["fr"]), (5, "mul", SAMPLES["de"] + "\n\n" + SAMPLES["es"]),
        (6, "en", None), (7, None, ""), (8, None, "12 345 <p></p>\n!!!"), (9, "en", (SAMPLES["en"] + "\n") * 2000),
    ]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("key", F.lit("clash"))
    segments = language.language_segments(df, profiles=profiles)
    got = {(r.key, r.line_no): r.lang for r in language.language_cases(segments).collect()}
    assert got == {("3", 0): "en", ("4", 0): "fr", ("5", 0): got[("5", 0)], ("5", 1): "de", ("5", 3): "es"} and got[("5", 0)] in ("de", "es")
    assert all(0 <= r.confidence <= 1 for r in segments.collect())
    assert language.language_segments(df.limit(0), profiles=profiles).count() == 0
    assert language.language_segments(df.filter("lang is null")).count() == 0  # no labels, no profiles, no guess


def test_distance_against_brute_force():
    profiles = language.fit_profiles(list(SAMPLES.items()))
    line = "the old school near the station"
    dist, letters, used = language.distances(["", line, "é"], profiles)
    gram, _, _ = language.grams(np.r_[np.uint8(0), language.encode_lines([line])])
    f = profiles.feature[gram]
    f = f[f >= 0]
    kinds, counts = np.unique(f, return_counts=True)
    order = kinds[np.lexsort((kinds, -counts))]
    size = language.PROFILE_SIZE
    want = [sum(size if profiles.rank[x, i] >= size else min(size, abs(int(profiles.rank[x, i]) - r)) for r, x in enumerate(order)) / (len(order) * size) for i in range(len(profiles.languages))]
    assert dist[1] == pytest.approx(want) and letters[1] == 26 and used[1] == len(order) and used[0] == 0


def test_label_names(spark):
    df = spark.createDataFrame([(x,) for x in ("en", "eng", "en_US", "ENGLISH", " pt-BR ", "und", "mul", "xx", "", None, "en,fr")], "l string")
    assert [r[0] for r in df.select(language.label_language(F.col("l"))).collect()] == ["en", "en", "en", "en", "pt", None, None, None, None, None, None]
