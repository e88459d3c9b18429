"""Rules, licences, quotes, classifier and decontamination on small inputs with nulls, ties and repeats."""

import random
import re
import time

import numpy as np
import pytest
import regex

from tessera.llm import classifier, decontaminate, licenses, quality_rules, quotes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _docs(spark, texts, extra=False):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        df = df.selectExpr("*", "1 as n_words", "'x' as kept", "0 as score", "'y' as digest")
    return df


PROSE = "\n".join(f"Line {i} has words that stand alone {i * 7} and it ends well." for i in range(8))
TEXTS = [PROSE, PROSE, None, "", " \t\n", "| home | about |\n" * 20, "# $ % & " * 30, ("same words again and again here now ok " * 40), "word " * 60 + ".", "a\x0bb\x0cc\rd e"]


def _measures(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = {w for w in windows if windows.count(w) > 1}
    covered = {j for i, w in enumerate(windows) if w in many for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_quality_measures_equal_brute_force(spark):
    random.seed(3)
    texts = TEXTS + [" ".join(random.choice("abcd") for _ in range(random.randint(0, 120))) for _ in range(60)]
    out = {r["doc_id"]: r for r in quality_rules.clean(_docs(spark, texts, extra=True)).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        want = _measures(t)
        got = tuple(out[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert got == want, (i, t)
        assert out[i]["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (out[i]["base_failed"] and out[i]["kept"])
    assert out[0]["kept"] and out[1]["kept"] and not out[5]["kept"] and not out[6]["kept"]


def test_lines_may_end_in_tabs_and_texts_may_be_long(spark):
    tabbed = "\n".join(x + " \t\r" for x in PROSE.split("\n"))
    long = " ".join(f"w{i}" for i in range(30_000)) + "."
    out = {r["doc_id"]: r for r in quality_rules.clean(_docs(spark, [PROSE, tabbed, long, long + " " + long])).collect()}
    assert [out[i]["kept"] for i in range(4)] == [True, True, True, False]
    assert out[2]["n_words"] == 30_000 and out[2]["n_repeat_words"] == 0 and out[3]["n_repeat_words"] > 59_000


def test_quality_rules_on_an_empty_table(spark):
    assert quality_rules.clean(_docs(spark, [])).count() == 0


def test_licences_by_text_and_by_line(spark):
    mit = next(t for t in licenses.full_texts()["MIT"] if t.startswith("MIT License"))
    texts = [mit, mit.upper().replace("Copyright (c) <year>".upper(), "Copyright (C) 2020 Someone"), mit.replace("License", "Licence"), "Some prose.\nReleased under the MIT License.\nMore.", "released, under THE mit licence!", None, "", "MIT License and more"]
    out = {r["doc_id"]: r for r in licenses.scan(_docs(spark, texts, extra=True)).collect()}
    assert [out[i]["license_id"] for i in range(8)] == ["MIT", "MIT", "MIT", None, "MIT", None, None, None]
    assert out[3]["notices"] == ["MIT"] and out[5]["notices"] == []
    few = licenses.scan(_docs(spark, texts), max_broadcast=1)
    assert {(r["doc_id"], r["license_id"]) for r in few.collect()} == {(i, out[i]["license_id"]) for i in range(8)}


def test_quotes_link_to_their_originals(spark):
    rows = [
        (1, 0, "user", "Where is the key?\n\nI looked twice."), (1, 1, "assistant", "> Where is the key?\n\nUnder the mat."),
        (1, 2, "user", "On Monday someone wrote:\n> > where is THE key\n> Under the mat.\nThanks!"), (2, 0, "user", "> Under the mat.\nWhich mat?"),
        (2, 0, "user", "> Under the mat.\nWhich mat?"), (3, 0, "user", None), (None, None, None, ""), (4, 0, "user", "> never said anywhere\nHm."),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as depth", "2 as key")
    out = quotes.link(df).collect()
    assert len(out) == len(rows)
    at = {(r["conv_id"], r["turn"]): r for r in out}
    assert at[1, 1]["clean_text"] == "Under the mat." and (at[1, 1]["parent_conv"], at[1, 1]["parent_turn"]) == (1, 0)
    assert at[1, 2]["clean_text"] == "Thanks!" and at[1, 2]["parent_turn"] == 1 and at[1, 2]["n_linked"] == 2 and at[1, 2]["max_depth"] == 2
    assert (at[2, 0]["parent_conv"], at[2, 0]["parent_turn"]) == (1, 1)
    assert at[4, 0]["n_quotes"] == 1 and at[4, 0]["n_linked"] == 0 and at[4, 0]["parent_conv"] is None
    assert sorted(r["reply_order"] for r in out if r["conv_id"] == 1) == [1, 2, 3]
    # the second conversation answers the first, so both are one thread; its two equal rows are one message
    assert [(r["reply_order"], r["thread_id"], r["depth"]) for r in out if r["conv_id"] == 2] == [(4, 1, 2)] * 2


def test_quotes_of_some_lines_of_a_paragraph(spark):
    rows = [
        (1, 0, "user", "First line here.\nSecond line here.\nThird line here."), (1, 1, "user", "> Second line here.\n> Third line here.\nYes."),
        (1, 2, "user", "> not said anywhere\n> Third line here.\n\n> not said anywhere\n> third LINE here\nNo."),
        (2, 0, "user", "> Second line here.\n> Yes.\nWell."), (3, 0, "user", "> ...\n> nothing of it\nHm."),
        (4, 0, "user", "A one.\nA two."), (4, 1, "user", "A two."), (4, 2, "user", "> A one.\n> A two.\nSo."),
    ]
    out = {(r["conv_id"], r["turn"]): r for r in quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(out) == len(rows)
    parent = lambda c, t: (out[c, t]["n_quotes"], out[c, t]["n_linked"], out[c, t]["parent_conv"], out[c, t]["parent_turn"])
    assert parent(1, 1) == (1, 1, 1, 0) and parent(1, 2) == (2, 1, 1, 0)
    assert parent(2, 0) == (1, 1, 1, 0) and parent(3, 0) == (1, 0, None, None) and parent(4, 2) == (1, 1, 4, 0)


def test_every_known_text_is_found_whole(spark):
    known = [(k, t) for k, ts in licenses.known_texts().items() for t in ts]
    assert {"GPL-3.0", "Apache-2.0", "BSD-3-Clause", "MPL-2.0", "CC0-1.0", "Unlicense"} <= {k for k, _ in known}
    texts = [t.upper() if i % 2 else "  " + "\r\n".join(t.split("\n")) for i, (_, t) in enumerate(known)]
    out = {r["doc_id"]: r["license_id"] for r in licenses.scan(_docs(spark, [*texts, "x " + texts[0]])).collect()}
    assert [out[i] for i in range(len(texts))] == [k for k, _ in known] and out[len(texts)] is None
    assert licenses.scan(_docs(spark, [])).count() == 0
    odd = spark.createDataFrame([(None, None), (None, texts[0]), (1, "word " * 200_000)], "doc_id long, text string")
    assert sorted(str(r["license_id"]) for r in licenses.scan(odd).collect()) == sorted(["None", "None", known[0][0]])


def _messages(seed, n):
    """Messages that quote whole paragraphs or lines of others, in order, out of order, across conversations, and in circles."""
    rng = random.Random(seed)
    said = {i: "\n".join(f"Sentence {rng.randint(0, 10**6)} of m{i}." for _ in range(rng.randint(1, 3))) for i in range(n)}
    rows = []
    for i in range(n):
        conv, turn = rng.choice([None, *range(1, n // 5)]), rng.choice([None, *range(4)])
        parts = []
        for _ in range(rng.choice([0, 1, 1, 2])):
            lines = said[rng.randrange(n)].split("\n")
            a = rng.randrange(len(lines))
            depth = rng.choice(["> ", "> ", "> > "])
            parts.append("\n".join(depth + x for x in lines[a : rng.randint(a + 1, len(lines))]))
        rows.append((conv, turn, "user", "\n\n".join([*parts, rng.choice(["> ***\n", ""]) + said[i]])))
    return rows + rows[:3]


def _walked(rows, mids):
    """Threads, answers and depth-first numbers one message at a time."""
    fold = lambda t: regex.sub(r"[^\p{L}\p{N}]+", " ", t.lower()).strip()
    nodes, own, quotes_ = {}, {}, {}
    for (conv, turn, _, text), mid in zip(rows, mids):
        nodes[mid] = (conv if conv is not None else -(1 << 63), (turn is not None, turn or 0), mid)
        runs, last = [], None
        for line in text.split("\n"):
            depth = line.count(">") if line.startswith(">") else 0
            body = line.lstrip("> ") if depth else line
            if not body.strip():
                last = None
                continue
            if last != depth:
                runs.append((depth, []))
            runs[-1][1].append(body)
            last = depth
        own[mid] = {fold(x) for d, ls in runs if not d for x in [*ls, "\n".join(ls)]}
        quotes_[mid] = {(d, fold("\n".join(ls))): [fold("\n".join(ls)), *(map(fold, ls) if len(ls) > 1 else [])] for d, ls in runs if d}
    order = sorted(nodes, key=nodes.get)
    up, linked = {}, {}
    for m in nodes:
        found = []
        for (depth, _), keys in quotes_[m].items():
            for k in filter(None, keys):
                inside = next((x for x in order if nodes[x][0] == nodes[m][0] and k in own[x]), None)
                far = next((x for x in order if k in own[x]), None) if len(k.split()) >= 3 else None
                to = inside if inside and nodes[inside] < nodes[m] else far if far and far != m else inside if inside != m else None
                if to:
                    found.append((depth, nodes[to], to))
                    break
        linked[m] = len(found)
        if found:
            up[m] = min(found)[2]
    parent = dict(up)
    for m in sorted(nodes):  # the smallest of each circle is met first
        x = m
        for _ in nodes:
            x = up.get(x)
            if x == m and not any(y < m for y in _ring(up, m)):
                del up[m]
                break
    thread = {nodes[m][0]: nodes[m][0] for m in nodes}
    find = lambda c: c if thread[c] == c else find(thread[c])
    for m, p in up.items():
        a, b = sorted((find(nodes[m][0]), find(nodes[p][0])))
        thread[b] = a
    below = {}
    for m in order:
        below.setdefault(up.get(m, find(nodes[m][0])), []).append(m)
    place, depth = {}, {}

    def visit(m, level, counter):
        counter[0] += 1
        place[m], depth[m] = counter[0], level
        for x in below.get(m, []):
            visit(x, level + 1, counter)

    for t in {find(c) for c in thread}:
        counter = [0]
        for m in below.get(t, []):
            visit(m, 0, counter)
    return {m: (linked[m], nodes[parent[m]][0] if m in parent else None, find(nodes[m][0]), depth[m], place[m]) for m in nodes}


def _ring(up, m):
    x, out = up[m], [m]
    while x != m:
        out.append(x)
        x = up[x]
    return out


@pytest.mark.parametrize("seed,n", [(1, 40), (2, 60), (3, 15)])
def test_threads_equal_a_plain_walk(spark, seed, n):
    rows = _messages(seed, n)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    mids = [r["mid"] for r in quotes.parse(df.coalesce(1)).collect()]
    want = _walked(rows, mids)
    out = quotes.link(df).collect()
    none = lambda x: None if x == -(1 << 63) else x
    got = [(r["n_linked"], r["parent_conv"], r["thread_id"], r["depth"], r["reply_order"]) for r in out]
    assert sorted(got, key=str) == sorted([(a, none(b), none(c), d, e) for a, b, c, d, e in (want[m] for m in mids)], key=str)


def test_threads_of_nothing_and_long_texts(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert quotes.link(spark.createDataFrame([], schema)).count() == 0
    long = " ".join(f"word{i}" for i in range(20_000))
    out = quotes.link(spark.createDataFrame([(1, 2, "user", "> " + long + "\nyes"), (1, 5, "user", long), (2, 1, "user", "> > \n> }")], schema)).collect()
    at = {(r["conv_id"], r["turn"]): (r["parent_turn"], r["depth"], r["reply_order"]) for r in out}
    assert at == {(1, 5): (None, 0, 1), (1, 2): (5, 1, 2), (2, 1): (None, 0, 1)}


def test_trees_follow_a_plain_walk():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0.2) ^ (x[:, 2] > 0)).astype(float)
    model = classifier.fit(x, y, trees=20)

    def walk(row):
        total = model.base
        for at in model.roots:
            while model.first[at] != at:
                at = model.first[at] + (row[model.feature[at]] > model.threshold[at])
            total += model.value[at]
        return total

    assert np.allclose(model.margin(x[:50]), [walk(r) for r in x[:50]])
    assert ((model.predict(x) > 0.5) == (y > 0.5)).mean() > 0.95


def test_classifier_on_held_out_labels(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = classifier.classify(docs.withColumnRenamed("lang", "score"), labels).join(labels, "doc_id").toPandas()
    held = out[out.held_out]
    assert ((held.predicted == 1) == (held.quality == 1)).mean() > 0.8
    assert out.score.between(0, 1).all()


def test_classifier_without_usable_labels(spark):
    docs = _docs(spark, TEXTS)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in classifier.classify(docs, none).collect()} == {0.5}
    assert classifier.classify(_docs(spark, []), none).count() == 0


def _brute_tiles(text, item, least):
    marked_t, marked_i, total = set(), set(), []
    while True:
        best, where = least - 1, []
        for i in range(len(text)):
            for j in range(len(item)):
                n = 0
                while i + n < len(text) and j + n < len(item) and text[i + n] == item[j + n] and i + n not in marked_t and j + n not in marked_i:
                    n += 1
                if n > best:
                    best, where = n, []
                if n == best and n >= least:
                    where.append((i, j))
        if not where:
            return total
        for i, j in where:
            if not marked_t & set(range(i, i + best)) and not marked_i & set(range(j, j + best)):
                marked_t |= set(range(i, i + best))
                marked_i |= set(range(j, j + best))
                total.append((i, j, best))


def test_tiling_equals_brute_force():
    rng = random.Random(9)
    for _ in range(150):
        text = [rng.randint(1, 3) for _ in range(rng.randint(0, 25))]
        item = [rng.randint(1, 3) for _ in range(rng.randint(0, 15))]
        assert decontaminate.tiles(text, item, 3) == _brute_tiles(text, item, 3)


def test_leaks_are_found_also_when_reordered(spark):
    item = " ".join(f"w{i}" for i in range(30))
    w = item.split()
    texts = ["before " + item + " after", "x " + " ".join(w[20:] + ["y"] + w[:20]).upper(), " ".join(w[:8]), None, "", "all other words " * 40, "short one"]
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "short one"), (7, item)], "item_id long, text string")
    out = {r["doc_id"]: r for r in decontaminate.scan(_docs(spark, texts, extra=True), bench).collect()}
    assert [out[i]["contaminated"] for i in range(7)] == [True, True, False, False, False, False, True]
    assert out[0]["item_ids"] == [7] and out[0]["cover"] == 1.0 and out[6]["item_ids"] == [10]
    shuffled = decontaminate.scan(_docs(spark, texts), bench, max_seeds=1)
    assert {(r["doc_id"], tuple(sorted(set(r["item_ids"])))) for r in shuffled.collect()} == {(i, tuple(out[i]["item_ids"])) for i in range(7)}
    assert {r["doc_id"] for r in decontaminate.clean(_docs(spark, texts, extra=True), bench).collect()} == {2, 3, 4, 5}
    assert decontaminate.scan(_docs(spark, []), bench).count() == 0
    nothing = decontaminate.scan(_docs(spark, texts), bench.limit(0))
    assert not any(r["contaminated"] for r in nothing.collect())


@pytest.mark.parametrize("size", [1, 4, 32, 100])
def test_windows_of_the_running_hash_agree(size):
    codes, seen = np.array([random.Random(1).randint(1, 5) for _ in range(200)], np.uint64), {}
    for part in (codes, codes[37:]):
        for i, h in zip(*decontaminate._windows(part, np.zeros(len(part), bool), size, decontaminate._powers(200))):
            assert seen.setdefault(int(h), part[i : i + size].tolist()) == part[i : i + size].tolist()
    assert len(seen) == len({tuple(codes[i : i + size].tolist()) for i in range(201 - size)})


@pytest.mark.parametrize("max_seeds", [10**6, 0])
def test_covers_equal_brute_force(spark, max_seeds):
    rng = random.Random(max_seeds)
    items = [(i, " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 9)) for _ in range(rng.choice([2, 5, 12, 40])))) for i in range(25)] + [(3, "a1 b2")]
    texts = []
    for _ in range(60):
        parts = [rng.choice(items)[1].split() for _ in range(rng.randint(0, 3))]
        texts.append(" ".join(w for p in parts for a in [rng.randrange(len(p))] for w in ["zz", *p[a:], *rng.choices("xyz", k=rng.randint(0, 3)), *p[:a]]).title())
    found = decontaminate.scan(_docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"), max_seeds=max_seeds).collect()
    for r in found:
        best = {}
        for i, t in items:
            item, text = t.split(), texts[r["doc_id"]].lower().split()
            share = sum(n for _, _, n in _brute_tiles(text, item, min(5, len(item)))) / len(item)
            if share >= 0.5:
                best[i] = max(share, best.get(i, 0))
        assert r["item_ids"] == sorted(best) and abs(r["cover"] - max(best.values(), default=0)) < 1e-12


def test_repetitive_and_long_texts_take_little_time():
    began = time.time()
    same = np.ones(20_000, np.uint64)
    assert decontaminate.covered(same, same[:200], 5) == 1.0
    two = np.tile(np.array([1, 2, 3, 1, 2], np.uint64), 4000)
    assert decontaminate.covered(two, np.tile(np.array([1, 2, 3], np.uint64), 60), 5) >= 0.0
    assert time.time() - began < 10


