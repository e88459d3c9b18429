"""Archives, mixing, Jaccard join, suffix dedup, token files and the pipeline against brute force and exact round trips."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
import xxhash
import zstandard

from tessera.llm import classifier, decontaminate, jaccard, licenses, mixing, quality_rules, registry, suffix_dedup, tokens, warc
from tessera.llm.common import scratch_path

DOC = "doc_id long, text string"


def _frame(spark, rows, schema=DOC):
    return spark.createDataFrame(rows, schema)


# --- WARC --------------------------------------------------------------------------------------------------------------


def test_archives_round_trip(spark):
    big = "x" * 150
    pages = [(3, "http://c", big), (1, "http://a", big), (2, "http://b", None), (4, None, "tiny"), (5, "u", "tiny"), (None, "n", big), (6, "é ü", "<p>ß</p>" * 5000), (7, "http://g", ""), (1, "http://a", big)]
    df = _frame(spark, pages * 1, "page_id long, url string, html string").selectExpr("*", "1 as record_type", "2 as n")
    path = scratch_path(spark, "t-warc")
    warc.write_archives(df, path)
    out = warc.read_archives(spark, path).collect()
    assert len(out) == len(pages) and all(r["valid"] for r in out)
    for r in out:
        html = next(h or "" for p, _, h in pages if p == r["page_id"])
        assert r["payload_bytes"] == len(html.encode()) and r["payload_digest"] == hashlib.sha256(html.encode()).hexdigest()
        revisit = html == big and r["page_id"] != 1
        assert (r["record_type"], r["refers_to"]) == (("revisit", 1) if revisit else ("response", None))
        assert r["payload"] == (b"" if revisit else html.encode())


def test_archives_of_nothing(spark):
    path = scratch_path(spark, "t-warc")
    warc.write_archives(_frame(spark, [], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0


def test_dictionary_in_the_leading_frame():
    samples = [f"record {i} with a common middle part {i % 7}".encode() * 4 for i in range(400)]
    learned = zstandard.train_dictionary(4096, samples)
    packer = zstandard.ZstdCompressor(dict_data=learned)
    for body in (learned.as_bytes(), zstandard.compress(learned.as_bytes())):
        data = struct.pack("<II", warc.DICT_MAGIC, len(body)) + body + b"".join(packer.compress(s) + warc.EMPTY_FRAME for s in samples[:20])
        assert list(warc.frames(data)) == samples[:20]
        with pytest.raises(warc.WarcError):
            list(warc.frames(data[:-12]))


def test_bad_records_are_refused():
    good = warc.record(1, "http://a", b"body", 4, hashlib.sha256(b"body").hexdigest(), None, False, "2024-01-01T00:00:00Z")
    headers, block = warc.parse_record(good)
    assert headers["WARC-Type"] == "response" and block.endswith(b"\r\n\r\nbody")
    for bad in (good[:-1], good + b"x", good.replace(b"WARC/1.1", b"HTTP/1.1"), good.replace(b"WARC-Date", b"Other"), good.replace(b"WARC-Date: ", b"WARC-Date ")):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)


# --- mixing ------------------------------------------------------------------------------------------------------------


def _targets(sizes, share=1.5):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), share * sum(sizes.values())
    while True:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.discard(s)


def test_mix_meets_targets(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice([None, "a", "b", "B", "ü", "c", "c", "c", "c"])) for i in range(3000)]
    rows += [(None, "null id here", "a"), (5, None, "b"), (5, "", None), (7, rows[7][1], rows[7][2])]
    df = _frame(spark, rows, "doc_id long, text string, source string").selectExpr("*", "'q' as size", "1 as target")
    out = mixing.mix(df).toPandas()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = _targets(sizes)
    assert len(out) == len(rows) and (out.taken <= 2 * out["size"]).all()
    assert {round(x, 3) for x in out.target} == {round(x, 3) for x in want.values()}
    for target, group in out.groupby(out.target.round(3)):
        sources = sum(round(x, 3) == target for x in want.values())
        assert abs(group.taken.sum() - target * sources) <= 31 * 3 * sources
    assert abs(out.taken.sum() - 1.5 * sum(sizes.values())) <= 31
    again = mixing.mix(df.repartition(7)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert out[key].fillna(-1).sort_values(key).values.tolist() == again[key].fillna(-1).sort_values(key).values.tolist()
    assert mixing.repeated(df).count() == int((out.taken[out["size"] > 0] / out["size"][out["size"] > 0]).sum())


def test_mix_of_little(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix(_frame(spark, [], schema)).count() == 0
    assert mixing.mix(_frame(spark, [(1, None, "a"), (2, "", None)], schema)).toPandas().taken.tolist() == [0, 0]
    one = mixing.mix(_frame(spark, [(1, "a b c d", "s")], schema)).toPandas()
    assert one.taken[0] <= 8 and one.target[0] == 6.0


def _fair(rows):
    """Words taken of each row (key, doc_id, source, size), one finish time after another; documents are shuffled by slice and key."""
    total, per = sum(r[3] for r in rows), {}
    for _, _, source, size in rows:
        per[source] = per.get(source, 0) + size
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(per, key=lambda s: (s is None, s)))}
    target, left, budget = {}, dict(per), 1.5 * total
    while left:  # hold at its limit whatever its share by weight exceeds, then share again
        rate = budget / sum(weight[s] for s in left)
        full = [s for s in left if rate * weight[s] > 2 * per[s]]
        if not full:
            target |= {s: rate * weight[s] for s in left}
            break
        for s in full:
            target[s] = 2.0 * per[s]
            budget -= target[s]
            del left[s]
    items = []
    for source in per:
        cum = 0
        for i, (key, doc, _, size) in sorted(((i, r) for i, r in enumerate(rows) if r[2] == source), key=lambda x: ((x[1][0] >> 20) % mixing.SLICES, x[1][0], x[1][1], x[1][3])):
            cum += size
            items += [((n * per[source] + cum) / target[source], (source is not None, source), key, doc, n, i) for n in (0, 1) if size and target[source]]
    taken, used = [0] * len(rows), 0
    for *_, i in sorted(items):
        if used + rows[i][3] > int(1.5 * total):
            break
        used += rows[i][3]
        taken[i] += rows[i][3]
    return taken, target


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_equals_a_plain_fair_queue(spark, seed):
    rng = random.Random(seed)
    sources = ["a", "b", "c", "d", None]
    rows = [(i, "w " * rng.choice([0, 1, 5, 40, 900]) + f"t{i}" * (i % 7 > 0), rng.choices(sources, [9, 1, 1, 3, 1])[0]) for i in range(400)]
    df = _frame(spark, rows, "doc_id long, text string, source string")
    keyed = [tuple(r) for r in df.select(mixing._key(), "doc_id", "source", mixing.words(df["text"])).collect()]
    taken, target = _fair(keyed)
    want = {r[1]: (t, target[r[2]]) for r, t in zip(keyed, taken)}
    out = mixing.mix(df).collect()
    assert {r["doc_id"]: r["taken"] for r in out} == {d: t for d, (t, _) in want.items()}
    assert all(abs(r["target"] - want[r["doc_id"]][1]) < 1e-6 * max(1, r["target"]) for r in out)


def test_equal_rows_are_repeated_as_often_as_planned(spark):
    rows = [(1, "a b c", "s", i) for i in range(5)] + [(i, "x y " * i, "t", i) for i in range(2, 9)]
    df = _frame(spark, rows, "doc_id long, text string, source string, n long")
    plan = {}
    for r in mixing.mix(df).collect():
        plan[r["doc_id"]] = plan.get(r["doc_id"], 0) + r["taken"] // max(r["size"], 1)
    got = {}
    for r in mixing.repeated(df).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {d: n for d, n in plan.items() if n}


# --- Jaccard join ------------------------------------------------------------------------------------------------------


def _components(rows):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        k = min(5, len(w))
        if d is not None and w:
            sets.setdefault(d, []).append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)})
    ids, up = list(sets), {d: d for d, _ in rows if d is not None}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if any(100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return {d: root(d) for d in up}


def _near_copies(seed, groups, members, words):
    rng, rows = random.Random(seed), []
    passage = [f"p{i}" for i in range(50)]
    for g in range(groups):
        base = [f"g{g}x{rng.randint(0, 10**6)}" for _ in range(words)]
        if g % 2:
            base[10:10] = passage
        for _ in range(members):
            text = list(base)
            for _ in range(rng.randint(0, max(1, words // 40))):
                text[rng.randrange(len(text))] = f"new{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(text)))
    return rows


@pytest.mark.parametrize("words", [3, 12, 60, 700])
def test_join_equals_brute_force(spark, words):
    rows = _near_copies(words, 6, 6, words)
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " \t"), (len(rows) + 3, " \t"), (None, rows[0][1]), (900, rows[0][1].upper()), (901, "a b c"), (902, "A  b\nc"), (2, rows[-1][1])]
    out = jaccard.join(_frame(spark, rows).selectExpr("*", "1 as n", "'x' as component")).collect()
    assert len(out) == len(rows)
    want = _components(rows)
    assert {(r["doc_id"], r["component_id"]) for r in out} == {(d, want.get(d)) for d, _ in rows}


def test_shingles_equal_brute_force():
    rng = random.Random(1)
    pick = ["a", "b", "Ab", "ab", "é" * 3, "x" * 300, "x" * 299 + "y", "\n", "\x1c", "\u00a0"]
    texts = [None, b"", *(" ".join(rng.choices(pick, k=rng.choice([0, 1, 3, 4, 5, 6, 20, 200]))).encode() for _ in range(150))]
    elements, counts = jaccard.sets_of(texts)
    sets = np.split(elements, np.cumsum(counts)[:-1])
    words = [(t or b"").lower().split() for t in texts]
    plain = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    assert counts.tolist() == [len(x) for x in plain]
    for _ in range(1500):
        i, j = rng.randrange(len(texts)), rng.randrange(len(texts))
        assert len(plain[i] & plain[j]) == len(np.intersect1d(sets[i], sets[j]))


def test_signatures_are_shared_by_all_matching_sets():
    """Pairs at and above the threshold, of all sizes; some sets are so small or so uneven that they need the further partitionings."""
    rng = np.random.default_rng(4)
    for n in [*range(1, 40), 66, 67, 90, 130, 300, 520, 900, 3000]:
        for _ in range(40):
            m = int(rng.integers(n, 4 * n // 3 + 1))
            least = -(-3 * (n + m) // 7)
            if least > n:
                continue
            both = least if rng.random() < 0.7 else int(rng.integers(least, n + 1))
            pool = rng.integers(0, (1 << 64) - 1, n + m - both, dtype=np.uint64)
            assert jaccard.linked(n, m, both) and len(np.unique(pool)) == len(pool)
            keys, of = jaccard.signatures(np.concatenate([np.sort(pool[:n]), np.sort(pool[n - both :])]), np.array([n, m]))
            assert len(np.intersect1d(keys[of == 0], keys[of == 1])), (n, m, both)


def test_uneven_sets_are_covered(monkeypatch):
    """All elements in one corner of the domain: no partitioning by the first hash covers them, and the prefix filter comes last."""
    rng = np.random.default_rng(5)
    for seeds in (1, 2, 8):
        monkeypatch.setattr(jaccard, "SEEDS", seeds)
        for n in (1, 2, 5, 9, 30, 70, 400):
            pool = np.unique(rng.integers(0, 1 << 30, 3 * n, dtype=np.uint64))[: n + n // 7]
            a, b = pool[:n], pool[n // 7 :] if n > 6 else pool[:n]
            if jaccard.linked(len(a), len(b), len(np.intersect1d(a, b))):
                keys, of = jaccard.signatures(np.concatenate([a, b]), np.array([len(a), len(b)]))
                assert len(np.intersect1d(keys[of == 0], keys[of == 1])), (seeds, n)


def test_only_documents_that_can_match_send_signatures(spark):
    rows = _near_copies(2, 3, 3, 300)
    alone = [(100 + i, " ".join(f"w{i}x{j}" for j in range(300))) for i in range(30)]
    left = {r["doc_id"] for r in jaccard.candidates(_frame(spark, rows + alone)).collect()}
    assert {d for d, _ in rows} <= left and len(left & {d for d, _ in alone}) <= 2


@pytest.mark.parametrize("block", [2, 512])
def test_lists_in_blocks(spark, block):
    rows = _near_copies(1, 2, 30, 80)
    out = jaccard.join(_frame(spark, rows), block).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == _components(rows)


def test_representatives_and_empty_tables(spark):
    rows = _near_copies(3, 4, 4, 60) + [(3, "again another text"), (50, None), (51, None)]
    kept = jaccard.representatives(_frame(spark, rows).selectExpr("*", "'en' as lang")).collect()
    want = _components(rows)
    assert sorted(r["doc_id"] for r in kept) == sorted(set(want.values()))
    assert jaccard.join(_frame(spark, [])).count() == 0 and jaccard.representatives(_frame(spark, [])).count() == 0


# --- suffix dedup ------------------------------------------------------------------------------------------------------


def _stripped(rows, n=100):
    seen, out = set(), []
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, xxhash.xxh64_intdigest((rows[i][1] or "").encode())))
    for i in order:
        b = (rows[i][1] or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - n + 1):
            if b[p : p + n] in seen:
                gone[p : p + n] = True
            seen.add(b[p : p + n])
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((rows[i][0], len(b), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def _suffix_rows(seed):
    rng = random.Random(seed)
    letters = "abcdefgh é\n"
    text = lambda k: "".join(rng.choice(letters) for _ in range(k))
    shared = [text(k) for k in (99, 100, 101, 160, 450)]
    rows = [(i, text(rng.randint(0, 200)) + rng.choice(shared) + text(rng.randint(0, 80)) + (rng.choice(shared) if i % 3 else "")) for i in range(80)]
    rows += [(80, "a" * 350), (81, "ab" * 200), (82, "a" * 99), (83, None), (84, ""), (None, shared[-1]), (5, shared[3]), (5, rows[5][1]), (90, (text(45) * 12)), (91, "=" * 130 + "\n" + "=" * 130)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_dedup_equals_brute_force(spark, seed):
    rows = _suffix_rows(seed)
    out = suffix_dedup.dedup(_frame(spark, rows).selectExpr("*", "1 as batch", "2 as n_bytes"))
    assert sorted(map(tuple, out.collect()), key=str) == _stripped(rows)


@pytest.mark.parametrize("most", [3, 40])
def test_dedup_over_many_levels(spark, most):
    rows = [*_suffix_rows(3)[:60], *[(300, "q" * 400), (300, "q" * 150), (301, "q" * 400)]]
    out = suffix_dedup.dedup(_frame(spark, rows), most=most)
    assert sorted(map(tuple, out.collect()), key=str) == _stripped(rows)


def test_chunks_hold_every_window(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700)
    rng = random.Random(6)
    long = "".join(rng.choice("abcdef") for _ in range(4000))
    rows = [*_suffix_rows(3)[:40], (200, long), (201, long[900:3100]), (202, "zz" + long[:1500])]
    batch = suffix_dedup.Batch(_frame(spark, [r for r in rows]).toArrow(), 100)
    windows = {(p[0], p[1] + int(f) - int(b)) for _, w, bg, ps, h, fs, ls, _ in batch.all() for f0, l0 in zip(fs, ls) for f in range(f0, l0 + 1) for p, b in [(ps[w[f]], bg[w[f]])]}
    assert windows == {(i, s) for i, d in enumerate(batch.docs) for s in range(len(d[2]) - 99)}


@pytest.mark.parametrize("length", [8, 9, 33, 100])
def test_levels_are_suffix_arrays(length):
    rng = np.random.default_rng(length)
    family, seen = suffix_dedup.Family(length), set()
    for _ in range(30):
        text = rng.choice(np.frombuffer(b"ab\x00\xff", np.uint8), int(rng.integers(length, 400)), p=[0.9, 0.06, 0.02, 0.02])
        at = np.sort(rng.permutation(len(text) - length + 1)[: int(rng.integers(1, 300))])
        found = family.take(text, at)
        for a, hit in zip(at.tolist(), found.tolist()):
            window = text[a : a + length].tobytes()
            assert hit == (window in seen)
            seen.add(window)
        levels = [[x.text[a : a + length].tobytes() for a in x.order.tolist()] for x in family.levels]
        assert all(x == sorted(set(x)) for x in levels) and set().union(*levels) == seen and sum(map(len, levels)) == len(seen)
        assert all(len(a) > len(b) for a, b in zip(levels, levels[1:]))


def test_dedup_of_nothing_and_kept_text(spark):
    assert suffix_dedup.dedup(_frame(spark, [])).count() == 0
    out = suffix_dedup.dedup(_frame(spark, [(1, "x" * 60 + "y" * 60), (2, "x" * 60 + "y" * 60 + "tail")]), keep_text=True).collect()
    assert {r["doc_id"]: bytes(r["kept"]) for r in out} == {1: b"x" * 60 + b"y" * 60, 2: b"tail"}


# --- token files -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    rng = np.random.default_rng(1)
    for ids in (rng.integers(0, 50_257, 1000), np.zeros(5, int), np.array([0xFFFFFFFF, 1]), np.zeros(0, int)):
        body, lengths = tokens.pack(ids.astype("<u4"), bits)
        assert tokens.unpack(body, lengths, len(ids), bits).tolist() == ids.tolist()


@pytest.mark.parametrize("block", [7, 1 << 16])
def test_token_files_equal_the_tokenizer(spark, monkeypatch, block):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "BLOCK", block)
    rng = random.Random(block)
    rows = [(i * 3 % 101, "".join(rng.choice("ab, .\n1é'!’") for _ in range(rng.randint(0, 40)))) for i in range(101)]
    rows += [(200, None), (201, ""), (202, "<|endoftext|> a  b"), (203, " x \n\n y "), (7, rows[0][1]), (None, "no id"), (204, "word, " * 3000)]
    path = scratch_path(spark, "t-tokens")
    tokens.write_tokens(_frame(spark, rows).selectExpr("*", "1 as start", "2 as part"), path)
    out = sorted(tokens.read_tokens(spark, path).collect(), key=lambda r: r["start"])
    tk = Tokenizer.from_file(tokens.vocabulary())
    want = {}
    for d, t in rows:
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 0]
        want.setdefault(d, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    start = 0
    for r in out:
        assert r["start"] == start
        start += r["n_tokens"]
        want[r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))
    assert not any(want.values())
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in out]
    assert ids == sorted(ids)


@pytest.mark.parametrize("most", [0, 3, 50, 10**6])
def test_remembered_pieces_give_the_tokenizers_ids(monkeypatch, most):
    monkeypatch.setattr(tokens, "_MOST", most)
    monkeypatch.setattr(tokens, "_FRESH", most // 3)
    encoder, rng = tokens.Encoder(tokens.vocabulary()), random.Random(most)
    letters = [*map(chr, range(0x21, 0x7F)), *map(chr, range(0xC0, 0x250)), "\u00a0", "\u4e00", *" \n,." * 30, *"abcé1" * 20]
    odd = ["x 12 3a b's don't 'll", "a, b. c", "é, ×, ÷. é.", ",", ". ,", "a,\nb.\n", "x\n\ny", "a <|endoftext|> b<|endoftext|>, c", "\n", " ", "3, 4.", "a" * 400 + " b" * 300]
    for _ in range(30):
        texts = [*odd, *("".join(rng.choices(letters, k=rng.randint(0, 60))).strip(rng.choice(["", " \n"])) for _ in range(60)), None]
        for text, ids in zip(texts, encoder.encode([t and t.encode() for t in texts], b"\0\0\0\0")):
            assert ids.tolist() == [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 0], text
    assert len(encoder.fresh.code) <= most // 3 and len(encoder.old.code) <= most + most // 3 + 2_000


def test_tokens_of_nothing(spark):
    assert tokens.round_trip(_frame(spark, [])).count() == 0


# --- all of it ---------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, before = docs.columns, docs
    for n, (_, stage) in enumerate(p.STAGES[:-1]):
        path = scratch_path(spark, f"t-stage-{n}")
        stage(spark, before, sf_dir).write.parquet(path)
        after = spark.read.parquet(path)
        assert after.columns == names and after.count() > 0
        if n < 3:
            assert after.exceptAll(before).count() == 0
        before = after
    out = p.run(spark, sf_dir)
    assert out.count() == before.count() and out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_every_operator_takes_odd_rows(spark, sf_dir):
    """Nulls, repeats, a long text and columns of the operators' own names."""
    long = " ".join(f"w{i}" for i in range(20_000))
    rows = [(1, long, "a"), (1, long, "a"), (2, None, None), (None, None, "a"), (None, "x", None), (3, "", "b"), (4, long + " end", "b")]
    df = _frame(spark, rows, "doc_id long, text string, source string").selectExpr("*", "'k' as key", "1 as size", "'n' as name", "2 as n", "'h' as h", "0 as component")
    labels, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    for out in (
        quality_rules.clean(df), mixing.mix(df), licenses.scan(df), classifier.classify(df, labels), suffix_dedup.dedup(df), tokens.round_trip(df),
        decontaminate.scan(df, benchmark), jaccard.join(df),
    ):
        assert out.count() == len(rows)
    assert {r["component_id"] for r in jaccard.join(df).collect() if r["doc_id"] in (1, 4)} == {1}
    assert sorted(str(r["doc_id"]) for r in jaccard.representatives(df).collect()) == ["1", "2", "3", "None", "None"]


def test_every_operator_has_a_query():
    assert [k.split("_")[0] for k in sorted(registry.QUERIES, key=lambda k: int(k.split("_")[0][2:]))] == [f"op{n}" for n in range(1, 11)]
