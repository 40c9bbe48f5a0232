"""Each operator against a brute-force version of its contract, over the corpus of conftest.py."""

import base64
import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import common, exact_dedup, licenses, mixing, ngram_join, packing, quality, sharding, substring, tokens, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def by_id(df, key="doc_id"):
    out = {}
    for r in df.collect():
        assert r[key] not in out
        out[r[key]] = r
    return out


def test_substring(docs, rows):
    got = by_id(substring.substring_dedup(docs, batches=3))
    first = {}
    for i, t, _ in sorted(rows):
        w = words(t)
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    removed = 0
    for i, t, _ in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        r = got[i]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()), i
        assert {k for s in r.spans for k in range(s["first"], s["last"] + 1)} == gone
        removed += len(gone)
    assert removed > 1000


def test_substring_index_compacts_and_opens_again(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    index = substring.FingerprintIndex(spark, folder)
    frame = lambda pairs: spark.createDataFrame(pairs, "anchor long, ord long")
    assert index.ingest(frame([(1, 1), (2, 1), (2, 2)])).collect()[0].anchor == 2
    assert {r.anchor for r in index.ingest(frame([(1, 5), (3, 5), (4, 5)])).collect()} == {1}
    assert len(index.runs) == 1
    assert {tuple(r) for r in spark.table(index.runs[0][0]).collect()} == {(1, 1, 5), (2, 1, 2), (3, 5, 5), (4, 5, 5)}
    index.close()
    # another session, with another number of shuffle partitions
    later = spark.newSession()
    later.conf.set("spark.sql.shuffle.partitions", "3")
    index = substring.FingerprintIndex(later, folder)
    assert len(index.runs) == 1 and index.buckets == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {r.anchor for r in index.ingest(later.createDataFrame([(4, 4)], "anchor long, ord long")).collect()} == {4}
    assert len(index.runs) == 2 and later.conf.get("spark.sql.shuffle.partitions") == "3"
    index.close()
    assert [n for _, _, n in substring.FingerprintIndex(spark, folder).runs] == [4, 1]
    index.destroy()
    assert not (tmp_path / "index").exists()


def test_substring_runs_are_merge_joined_as_stored(spark, tmp_path):
    """Neither exchange nor sort nor broadcast, for hits and for compaction."""
    index = substring.FingerprintIndex(spark, f"file://{tmp_path}/index")
    index.ingest(spark.range(4000).selectExpr("id * 7 as anchor", "id as ord"))
    index.ingest(spark.range(500).selectExpr("id * 21 as anchor", "id + 9000 as ord"))
    assert len(index.runs) == 2
    with common.bounded(spark, substring.IN_ORDER):
        a, b = index._table(0, "f1", "l1").hint("merge"), index._table(1).hint("merge")
        for df in (index._shared(0), a.join(b, "anchor", "full")):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan, plan
            assert not any(w in plan.replace("SortMergeJoin", "") for w in ("Exchange", "Sort ", "Broadcast")), plan
        assert index._shared(0).count() == 500
    index.destroy()


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_path())


def test_token_counts(docs, rows):
    lib, got = library(), by_id(tokens.token_counts(docs))
    for i, t, _ in rows:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert tuple(got[i]) == (i, len((t or "").encode()), n, n > 512)


PARTS = ["a", "Bc", "é", "ß", "中", "文字", "。", "，", "か", "  ", "   ", " ", "\n", " \n", "\t", "\u00a0", " \u3000", "\u2003", "'s", "123", " 4", "!", "?.", "<|endoftext|>", "\x85", "\x1c", "🙂", "\u200b", "\r\n", "_", "\x00", "don't", " “"]


def mixtures(n, most):
    rng = np.random.default_rng(3)
    return ["".join(rng.choice(PARTS, rng.integers(0, most))) for _ in range(n)] + ["", " ", "  ", "a ", " a", "", "a  ", " <|endoftext|>", "x  <|endoftext|>  y"]


@pytest.mark.parametrize(("window", "long", "memo", "most"), [(1 << 21, 256, 10**6, 14), (40, 8, 50, 14), (64, 4, 10**6, 60), (1, 2, 0, 8)])
def test_units_are_cut_at_safe_boundaries(monkeypatch, window, long, memo, most):
    """Whatever the sizes of windows, units and the memory, ids and lengths are the library's."""
    import pyarrow as pa

    monkeypatch.setattr(tokens, "WINDOW_BYTES", window)
    monkeypatch.setattr(tokens, "LONG_UNIT", long)
    monkeypatch.setattr(tokens, "MEMO_UNITS", memo)
    lib, enc = library(), tokens.Encoder(tokens.tokenizer_path())
    texts = mixtures(1500, most)
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        frame = pa.array([*texts, None])
        assert enc.lengths(frame).tolist() == [*map(len, want), 0]
        got = []
        for first, ids, ends in enc.encode(frame.slice(3), slice_bytes=500):
            assert first == len(got)
            got += [ids[x:y].tolist() for x, y in itertools.pairwise(ends)]
        assert got == [*want[3:], []]


def test_a_vocabulary_with_another_pre_tokeniser_is_encoded_text_by_text():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    enc, lib = tokens.Encoder(path), Tokenizer.from_file(path)
    texts = mixtures(300, 14)
    assert not enc.cuts
    assert enc.lengths(pa.array(texts)).tolist() == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]


def test_word_hashes_tell_words_apart():
    from graphloom.llm import textkernel as tk

    rng = np.random.default_rng(4)
    text = [bytes(rng.integers(97, 100, rng.integers(1, 90)).astype(np.uint8)) for _ in range(20000)] + [b"ab" * 40, b"ab" * 40]
    ends = np.cumsum([len(w) for w in text])
    h = tk.span_hashes(np.frombuffer(b"".join(text), np.uint8), ends - [len(w) for w in text], ends)
    assert len(set(h.tolist())) == len(set(text)) and h[-1] == h[-2]
    assert {w: x for w, x in zip(text, h.tolist(), strict=True)} == {w: x for w, x in zip(text[::-1], h[::-1].tolist(), strict=True)}


def test_packing(docs, rows):
    lib = library()
    got = defaultdict(list)
    for r in packing.pack(docs).collect():
        got[r.doc_id].append(r)
    bins = defaultdict(list)
    total = 0
    for i, t, _ in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        at = 0
        pieces = sorted(got[i], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        for k, r in enumerate(pieces):
            assert r.start == at and (r.length == 2048 or k == 0)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
            bins[r.sequence_id].append((r.offset, r.length))
        assert at == len(ids) and (len(pieces) > 1) == (len(ids) > 2048)
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) == -(-total // 2048) or len(bins) <= 1.05 * total / 2048 + 1


@pytest.mark.parametrize("seed", range(6))
def test_plan_equals_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    lengths = sorted((int(x) for x in rng.integers(1, 101, 400)), reverse=True)
    free = []
    for n in lengths:
        fit = min((f for f in free if f >= n), default=None)
        if fit is None:
            free.append(100 - n)
        else:
            free.remove(fit)
            free.append(fit - n)
    slots = packing.plan(Counter(lengths), 100)
    assert max(s + hi - lo for _, lo, hi, s, _ in slots) == len(free)
    used = defaultdict(list)
    for n, lo, hi, first, offset in slots:
        for k in range(hi - lo):
            used[first + k].append((offset, n))
    assert sum(len(x) for x in used.values()) == len(lengths)
    for pieces in used.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 100


def test_warc_round_trip(spark, rows, tmp_path):
    path, folder = str(tmp_path / "pages.parquet"), f"file://{tmp_path}/archives"
    spark.createDataFrame([(i, f"http://x.example/é {i}\n" if i % 5 else None, t, "r") for i, t, _ in rows], "page_id long, url string, html string, rid string").repartition(3).write.parquet(path)
    manifest = warc.archive(spark.read.parquet(path), folder)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows)
    assert manifest.agg(F.max("dictionary_bytes")).first()[0] > 0
    got = by_id(warc.read(manifest), "page_id")
    top = {}
    for i, t, _ in rows:
        top[t or ""] = max(i, top.get(t or "", -1))
    for i, t, _ in rows:
        raw, r = (t or "").encode(), got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        if top[t or ""] == i:
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("response", None, raw)
        else:
            assert (r.record_type, r.refers_to) == ("revisit", top[t or ""])
    assert sorted(r.path.rsplit("/", 1)[1] for r in manifest.collect()) == sorted(p.name for p in (tmp_path / "archives").glob("part-*"))
    small = by_id(warc.read(warc.archive(spark.read.parquet(path), folder + "2", min_bytes=100)), "page_id")
    assert all(small[i].record_type == "response" for i, t, _ in rows if len((t or "").encode()) < 100)


def test_warc_round_trip_with_a_full_bitmap(spark, tmp_path, monkeypatch):
    """Where the bitmap rules nothing out, the join tells responses from revisits; archives of earlier attempts go."""
    monkeypatch.setattr(common, "BITMAP_BITS", 6)
    rows = [(i, f"u{i}", f"payload {i % 70}" if i % 3 else f"own {i}") for i in range(400)]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "part-000000-99999-0000.warc.zst").write_bytes(b"left by another attempt")
    manifest = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), f"file://{tmp_path}/a")
    assert len(list((tmp_path / "a").glob("part-*"))) == manifest.count()
    got, top = by_id(warc.read(manifest), "page_id"), {}
    for i, _, t in rows:
        top[t] = i
    assert {i: (r.record_type, r.refers_to, bytes(r.payload)) for i, r in got.items()} == {i: ("response", None, t.encode()) if top[t] == i else ("revisit", top[t], b"") for i, _, t in rows}


def test_warc_frames_stand_alone():
    import io

    import zstandard

    payloads = [f"<p>{'text ' * (i % 9)}{i}</p>".encode() for i in range(500)]
    records = [warc.record(i, i, "http://x", p, len(p), hashlib.sha1(p).digest()) for i, p in enumerate(payloads)]
    out = io.BytesIO()
    n, raw, size, d = warc.write_archive(out, iter(records))
    assert (n, raw, size) == (500, sum(map(len, records)), len(out.getvalue())) and d > 0
    data = out.getvalue()
    assert data[:4] == (0x184D2A5D).to_bytes(4, "little")
    assert list(warc.read_archive(io.BytesIO(data), chunk=100)) == records
    with pytest.raises(zstandard.ZstdError):
        at = 8 + int.from_bytes(data[4:8], "little")
        zstandard.ZstdDecompressor().decompress(data[at:])
    plain = io.BytesIO()
    assert warc.write_archive(plain, iter(records[:2]))[3] == 0
    assert list(warc.read_archive(io.BytesIO(plain.getvalue()))) == records[:2]


def test_sharding(spark, docs, rows):
    table = sharding.lookup_table()
    count = Counter(table)
    assert len(table) == sharding.SLOTS and max(count.values()) - min(count.values()) <= 1
    fewer = sharding.lookup_table(sharding.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != sharding.SHARDS[-1])
    assert moved < 0.12 * sharding.SLOTS
    got = by_id(sharding.assign(docs, "doc_id"))
    for i, _, _ in rows:
        slot = int(hashlib.sha256(str(i).encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert (got[i].slot, got[i].shard) == (slot, table[slot])
    clash = spark.createDataFrame([(None, "a", 5)], "doc_id long, shard string, slot int")
    assert sharding.assign(clash, "doc_id").first().shard == table[int(hashlib.sha256(b"").hexdigest()[:15], 16) % sharding.SLOTS]


def repeat_mask(w, k):
    at = defaultdict(list)
    for i in range(len(w) - k + 1):
        at[tuple(w[i : i + k])].append(i)
    return {p for v in at.values() if len(v) > 1 for i in v for p in range(i, i + k)}


def test_quality(docs, rows):
    rules = quality.Rules()
    got = by_id(quality.quality(docs))
    kept = set()
    for i, t, _ in rows:
        w, t = words(t), t or ""
        chars = sum(map(len, w))
        seen, dup, dup_chars = set(), 0, 0
        for line in t.split("\n"):
            if words(line):
                if line in seen:
                    dup += 1
                    dup_chars += sum(map(len, words(line)))
                seen.add(line)
        repeat, symbols = len(repeat_mask(w, 8)), sum(c in "#*$%&|<>" for c in t)
        base = len(w) < 20 or 100 * repeat > 30 * len(w)
        bad = dup_chars > rules.max_dup_line_chars * max(chars, 1) or symbols > rules.max_symbol_chars * max(chars, 1)
        for n, limit in rules.ngram_limits:
            bad |= sum(len(w[p]) for p in repeat_mask(w, n)) > limit * max(chars, 1)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.dup_line_chars, r.base_failed, r.kept) == (len(w), chars, symbols, dup, repeat, dup_chars, base, not (base or bad)), i
        if r.kept:
            kept.add(i)
    good = quality.keep_good(docs)
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == kept
    assert 0 < len(kept) < len(rows)


def test_mixing(docs, rows):
    plan = mixing.mix_plan(docs)
    got = by_id(plan)
    size = Counter()
    for i, t, s in rows:
        size[s] += len(words(t))
    wanted = {t.source: t.target for t in mixing.targets(list(size.items()))}
    assert abs(sum(wanted.values()) - 1.5 * sum(size.values())) < 1e-6
    taken = Counter()
    for i, t, s in rows:
        r = got[i]
        assert (r.size, r.source_size) == (len(words(t)), size[s]) and abs(r.target - wanted[s]) < 1e-6
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
    for s in size:
        assert abs(taken[s] - wanted[s]) <= 0.02 * wanted[s] + 3, (s, taken[s], wanted[s])
    assert {i: r.taken for i, r in by_id(mixing.mix_plan(docs)).items()} == {i: r.taken for i, r in got.items()}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: r.copies for i, r in got.items() if r.copies})


def test_mixing_targets_reshare():
    got = {t.source: t.target for t in mixing.targets([("b", 100), (None, 100), ("a", 10), ("c", 0)])}
    # a is above 20 by its weight 5, c has nothing; b and null share the rest by 2 and 5
    assert got["a"] == 20 and got["c"] == 0
    assert got["b"] + got[None] == pytest.approx(1.5 * 210 - 20)
    assert got[None] == pytest.approx(200) or got[None] / got["b"] == pytest.approx(5 / 2)


@pytest.mark.parametrize("seed", range(5))
def test_mixing_targets_against_water_filling(seed):
    """The level at which weights, cut off at twice each source's size, give the whole share: by bisection."""
    rng = np.random.default_rng(seed)
    names = sorted({f"{rng.choice(['a', 'B', 'é', '𝒳', '￿'])}{rng.integers(0, 30)}" for _ in range(12)}) + [None]
    sizes = {n: int(rng.choice([0, 3, 50, 1000, 10**7])) for n in names}
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    goal, lo, hi = 1.5 * sum(sizes.values()), 0.0, 1e12
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(2 * sizes[n], weight[n] * mid) for n in names) < goal else (lo, mid)
    shuffled = [(n, sizes[n]) for n in rng.permutation(np.array(names, object)).tolist()]
    for t in mixing.targets(shuffled):
        assert t.target == pytest.approx(min(2 * sizes[t.source], weight[t.source] * hi), rel=1e-6, abs=1e-6)


def test_mixing_copies_against_a_plain_version(spark):
    """Multipliers by bisection and copies by carrying, in plain Python: the same number of copies of every size."""
    rng = np.random.default_rng(12)
    rows = [(i, i, s, int(z), int(h)) for i, (s, z, h) in enumerate(zip(rng.choice(["a", "b", "c", "d"], 900), rng.integers(0, 40, 900) ** 2, rng.integers(0, 10**9, 900), strict=True))]
    got = mixing.copies(spark.createDataFrame(rows, "doc_id long, rid long, source string, size long, digest long")).collect()
    size, count = Counter(), Counter()
    for _, _, s, z, _ in rows:
        size[s] += z
        count[(s, z)] += 1
    for t in mixing.targets(list(size.items())):
        cells = sorted(((z, n) for (s, z), n in count.items() if s == t.source), reverse=True)
        mean = t.size / sum(n for _, n in cells)
        rate = lambda tilt, z, mean=mean: min(2.0, np.exp(min(tilt * z / mean, 50)))
        lo, hi = -60.0, 60.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(z * n * rate(mid, z) for z, n in cells) < t.target else (lo, mid)
        tilt = np.inf if t.target >= 2 * t.size else hi
        ideal, taken, want = 0.0, 0, {}
        for z, n in cells:
            ideal += z * n * (2.0 if np.isinf(tilt) else rate(tilt, z))
            want[z] = n if z == 0 else min(2 * n, max(0, int(np.floor((min(ideal, t.target) - taken) / z + 0.5))))
            taken += want[z] * z
        mine = Counter()
        for r in got:
            if r.source == t.source:
                mine[r.size] += r.copies
        assert all(abs(mine[z] - want[z]) <= 1 for z in want) and abs(sum(z * k for z, k in mine.items()) - t.target) <= max(2, cells[0][0])
        assert all(r.copies <= 2 for r in got)


def test_mixing_tilts_exponentially(spark):
    cells = spark.createDataFrame([("a", 10, 5), ("a", 20, 3), ("a", 40, 2)], "source string, size long, n long")
    total = 190
    for share in (0.3, 1.0, 1.7):
        tilt = mixing.solve(cells, [mixing.Target("a", total, share * total)], {"a": 10})["a"]
        mean = total / 10
        assert sum(n * z * min(2, np.exp(tilt * z / mean)) for z, n in ((10, 5), (20, 3), (40, 2))) == pytest.approx(share * total, rel=1e-5)


def test_licenses(spark, docs):
    mit, isc = licenses.TEXTS["MIT"], licenses.TEXTS["ISC"]
    commented = "\n".join(" * " + line.upper() for line in mit.split("\n"))
    filler = " ".join(f"filler{i} the of and" for i in range(3000))
    broken = mit.replace("sublicense", "lend").replace("merge", "join").replace("holders", "owners")
    data = [
        (1, mit), (2, f"{filler} {commented} {filler}"), (3, broken), (4, " ".join(reversed(mit.split()))), (5, None), (6, ""),
        (7, "Released under the MIT License. " + isc), (8, filler), (9, mit + filler + mit), (None, "Licensed under CC BY-NC 4.0."),
    ]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    names = lambda i: [f["license"] for f in got[i].found]
    assert names(1) == ["MIT"] and got[1].coverage == 1.0
    assert names(2) == ["MIT"] and got[2].found[0]["first"] >= 12000 - 10
    assert names(3) == ["MIT"] and 0.8 <= got[3].coverage < 1
    assert names(4) == names(5) == names(6) == names(8) == []
    assert set(names(7)) == {"MIT notice", "ISC"}
    assert names(9) == ["MIT"] and "CC-BY-NC-4.0 notice" in names(None)
    assert all(not r.found for r in licenses.license_scan(docs).collect())


def test_patience_alignment_is_increasing_and_equal():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = rng.integers(0, 30, rng.integers(0, 60)).tolist(), rng.integers(0, 30, rng.integers(0, 60)).tolist()
        m = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in m) and all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(m))
    assert len(licenses.align(list(range(50)), list(range(50)))) == 50
    assert licenses.align([1, 2, 3, 9, 5], [1, 2, 7, 8, 5]) == [(0, 0), (1, 1), (4, 4)]


def shingle_sets(rows, k):
    out = {}
    for i, t, _ in rows:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(t)]
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    return out


def brute_components(sets, t):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a, b in itertools.combinations(ids, 2):
        o = len(sets[a] & sets[b])
        if sets[a] and o * t.denominator >= t.numerator * (len(sets[a]) + len(sets[b]) - o) and sets[b]:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("k", "t"), [(3, Fraction(9, 10)), (5, Fraction(4, 5))])
def test_ngram_join(docs, rows, k, t):
    sets = shingle_sets(rows, k)
    want = brute_components(sets, t)
    got = by_id(ngram_join.jaccard_components(docs, k, t))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(sets[i]), want[i]) for i in sets}
    kept = ngram_join.keep_first(docs, k, t)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(want.values())


@pytest.mark.parametrize("cell", [3, 17, 800])
def test_ngram_join_near_the_threshold(spark, tmp_path, cell, monkeypatch):
    """Many variants of one text around the threshold, small sets, and chains: every way a link can be found."""
    monkeypatch.setattr(ngram_join, "CELL", cell)
    rng = np.random.default_rng(11)
    rows = []
    for base in range(3):
        w = [f"b{base}w{i}" for i in range(90)]
        for _ in range(45):
            x = list(w)
            for _ in range(rng.integers(0, 6)):
                x[rng.integers(0, len(x))] = f"z{rng.integers(0, 8)}"
            cut = rng.integers(0, 6)
            rows.append((len(rows), " ".join(x[cut : len(x) - rng.integers(0, 5)]), None))
    chain = [f"c{i}" for i in range(140)]
    rows += [(len(rows) + i, " ".join(chain[3 * i : 3 * i + 70]), None) for i in range(20)]
    for n in range(8, 16):
        for m in (n, n + 1):
            rows.append((len(rows), " ".join(f"s{n}x{i}" for i in range(m)), None))
    path = str(tmp_path / "docs.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(path)
    sets = shingle_sets(rows, 3)
    got = by_id(ngram_join.jaccard_components(spark.read.parquet(path)))
    assert {i: r.component_id for i, r in got.items()} == brute_components(sets, Fraction(9, 10))


def test_exact_dedup(docs, rows):
    got = by_id(exact_dedup.exact_dedup(docs, batches=3))
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    for i, t, _ in rows:
        g, r = groups[t or ""], got[i]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(g), len(g), i == max(g), hashlib.sha256((t or "").encode()).hexdigest())
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {max(g) for g in groups.values()}


def test_cuckoo_filter():
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    f = exact_dedup.CuckooFilter.for_keys(3000)
    assert not len(f.insert_many(keys)) and f.contains(keys).all()
    assert f.contains(rng.integers(0, 1 << 63, 20000, dtype=np.uint64)).mean() < 0.001
    again = exact_dedup.CuckooFilter.load(f.dump())
    for k in keys[:1500]:
        assert again.remove(int(k))
    assert again.contains(keys[1500:]).all() and again.contains(keys[:1500]).mean() < 0.01
    small = exact_dedup.CuckooFilter(2)
    assert len(small.insert_many(keys[:100])) > 0  # overflow
    grown = exact_dedup._grown(keys[:100], 2)
    assert grown.log2 > 2 and grown.contains(keys[:100]).all()


def digested(spark, pairs):
    return spark.createDataFrame([(i, i, hashlib.sha256(t.encode()).digest()) for i, t in pairs], "doc_id long, rid long, digest binary")


def test_cuckoo_index_inserts_and_deletes(spark):
    frame = lambda pairs: digested(spark, pairs)
    index = exact_dedup.CuckooIndex(spark, keys_per_part=16)
    index.insert(frame([(i, f"t{i % 40}") for i in range(100)]))
    index.insert(frame([(i, f"t{i % 40}") for i in range(100, 140)]))
    live = {(r.keep_id, r.n) for r in index.stored().collect()}
    assert live == {(max(i for i in range(140) if i % 40 == k), sum(i % 40 == k for i in range(140))) for k in range(40)}
    index.remove(frame([(i, f"t{i % 40}") for i in range(140) if i % 40 < 10]))
    assert index.stored().count() == 30
    index.insert(frame([(500, "t3"), (501, "t20")]))
    assert {(r.keep_id, r.n) for r in index.stored().collect()} >= {(500, 1), (501, 4)}
    assert index.stats().agg(F.sum("hits")).first()[0] >= 40
    index.destroy()


def test_cuckoo_index_names_no_dead_row_and_holds_each_fingerprint_once(spark, tmp_path):
    """Random insertions and deletions, by a session after another, against a plain dictionary; parts and filters grow."""
    rng, folder, rows = np.random.default_rng(6), f"file://{tmp_path}/cuckoo", set()
    for step in range(6):
        index = exact_dedup.CuckooIndex(spark.newSession() if step % 2 else spark, folder, keys_per_part=40)
        if step % 3 < 2:
            new = {(int(i), f"t{int(i) % (50 + 60 * step)}") for i in range(200 * step, 200 * step + 200)}
            index.insert(digested(index.spark, sorted(new)))
            rows |= new
        else:
            best = {}
            for i, t in rows:
                best[t] = max(i, best.get(t, -1))
            out = {(i, t) for t, i in best.items()} | {x for x in rows if rng.random() < 0.3}  # every live row, and others
            index.remove(digested(index.spark, sorted(out) + [(10**6, "t1"), (5, "never seen")]))
            rows -= out
        want = defaultdict(list)
        for i, t in rows:
            want[hashlib.sha256(t.encode()).digest()].append(i)
        assert {bytes(r.digest): (r.keep_id, r.n) for r in index.stored().collect()} == {d: (max(x), len(x)) for d, x in want.items()}
        filters = [exact_dedup.CuckooFilter.load(r.filter) for r in index.state().where("digest is null").collect()]
        assert sum(int((f.table != 0).sum()) for f in filters) == len(want)
        assert index.rows().count() == len(rows)
    assert index.parts > 4
    index.destroy()


def in_order(a, b):
    """The length of the longest common subsequence, by the table."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_licenses_wherever_they_begin_and_however_spread():
    scanner = licenses.Scanner(licenses.TEXTS, licenses.NOTICES, licenses.MIN_COVERAGE)

    def scan(text):
        numbers = scanner.number(licenses.words_of(text))
        return {f["license"]: f for f in scanner.scan(numbers, np.flatnonzero(scanner.candidates(numbers, np.array([0, len(numbers)]))[0]))}

    filler = lambda n: " ".join(["plain"] * n)
    notices = [("MIT notice", "Released under the terms and conditions of the MIT License.", 10), ("Apache-2.0 notice", "Licensed under the terms and conditions of the Apache License, Version 2.0.", 13)]
    for name, text, n in notices:
        for start in range(2 * n):
            got = scan(f"{filler(start)} {text} {filler(40)}")[name]
            assert (got["coverage"], got["first"], got["last"]) == (1.0, start, start + n - 1), (name, start)
    for name in ("BSD-2-Clause", "MIT", "Apache-2.0 header"):
        words = licenses.TEXTS[name].replace("*", "").split()
        for start in range(0, 2 * len(words), 7):
            for gap, at in ((120, len(words) // 2), (3 * len(words), len(words) // 3)):
                assert scan(f"{filler(start)} {' '.join(words[:at])} {filler(gap)} {' '.join(words[at:])} {filler(9)}")[name]["coverage"] == 1.0, (name, start, gap)
        assert scan(f" {filler(4)} ".join(words))[name]["coverage"] == 1.0


def test_licenses_match_as_much_as_the_longest_common_subsequence():
    rng = np.random.default_rng(2)
    for _ in range(300):
        b, text = rng.integers(0, 12, rng.integers(1, 30)).tolist(), rng.integers(-1, 14, rng.integers(0, 120)).tolist()
        scanner = licenses.Scanner({"t": "x"}, {}, 0.5)
        scanner.ids, scanner.need = [b], np.array([-(-len(b) // 2)])
        most, got = in_order([w for w in text if w >= 0], b), scanner.best(text, 0)
        assert len(got or []) == (most if most >= scanner.need[0] else 0)
        if got:
            assert in_order([text[i] for i in got], b) == most and got == sorted(set(got))
        m = licenses.longest(text, b)
        assert len(m) == most and all(text[i] == b[j] for i, j in m) and all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(m))


def scan_texts(texts):
    scanner = licenses.Scanner(licenses.TEXTS, licenses.NOTICES, licenses.MIN_COVERAGE)
    for text in texts:
        numbers = scanner.number(licenses.words_of(text))
        yield scanner.scan(numbers, np.flatnonzero(scanner.candidates(numbers, np.array([0, len(numbers)]))[0]))


def test_every_template_is_told_from_its_look_alikes(spark):
    """Each text and each notice, in prose, is found as itself and as nothing else."""
    plain = {name: [text.replace("*", "")] for name, text in licenses.TEXTS.items()} | {name: [x.replace("~", gap) for x in all_ for gap in ("", "the terms of the")] for name, all_ in licenses.NOTICES.items()}
    for name, texts in plain.items():
        for text, found in zip(texts, scan_texts([f"some words before {x} and after" for x in texts]), strict=True):
            assert [(f["license"], f["coverage"]) for f in found] == [(name, 1.0)], text


def test_notices_that_name_another_license():
    cases = {
        "Licensed under CC BY-ND 4.0.": ["CC-BY-ND-4.0 notice"],
        "Licensed under CC BY-NC-SA 4.0.": ["CC-BY-NC-SA-4.0 notice"],
        "Licensed under CC BY-XX 4.0.": [],
        "This work is licensed under the GNU General Public License, version 2.": ["GPL-2.0 notice"],
        "This work is licensed under the GNU General Public License, version 3.": ["GPL-3.0 notice"],
        "This work is licensed under the GNU Lesser General Public License, version 3.": ["LGPL-3.0 notice"],
        "This work is licensed under the GNU Affero General Public License, version 3.": ["AGPL-3.0 notice"],
        "Released under the BSD License.": ["BSD notice"],
        "Released under the ISC License.": ["ISC notice"],
        "Released under the MIT License. All rights reserved.": ["MIT notice", licenses.RESERVED],
        "Released under no license. The MIT people hold a license.": [],
        "licensed, they said, under\n# the\n# MIT license": [],
        "SPDX-License-Identifier: LGPL-2.1-or-later": ["LGPL-2.1 notice"],
        "all men have rights, and a table is reserved": [],
        "(c) A Company. All\n * rights reserved.": [licenses.RESERVED],
    }
    for text, found in zip(cases, scan_texts(cases), strict=True):
        assert [f["license"] for f in found] == cases[text], text


def test_headers_with_changes_keep_their_names():
    t = {k: v.replace("*", "") for k, v in licenses.TEXTS.items()}
    url = "if not, see <https://www.gnu.org/licenses/>."
    gpl2 = t["GPL-2.0 header"].split("if not, write")[0] + url
    cases = [
        ("GPL-2.0 header", gpl2), ("LGPL-2.1 header", t["LGPL-2.1 header"].split("if not, write")[0] + url), ("LGPL-3.0 header", t["LGPL-3.0 header"].replace("useful", "of use")),
        ("AGPL-3.0 header", t["AGPL-3.0 header"].replace("hope", "wish")), ("GPL-3.0 header", t["GPL-3.0 header"].replace("redistribute", "share")), ("BSD-2-Clause", t["BSD-2-Clause"].replace("BUSINESS", "TRADE")),
        ("BSD-3-Clause", t["BSD-3-Clause"].replace("BUSINESS", "TRADE")), ("MIT", t["MIT"].replace("sublicense", "lend")),
    ]
    for (name, _), found in zip(cases, scan_texts([c for _, c in cases]), strict=True):
        assert [f["license"] for f in found] == [name], name


def test_anchors_are_a_longest_increasing_chain():
    """Against the quadratic table, on words that occur once in both."""
    rng = np.random.default_rng(9)
    for _ in range(200):
        a, b = rng.integers(0, 40, rng.integers(0, 50)).tolist(), rng.integers(0, 40, rng.integers(0, 50)).tolist()
        once = [w for w in b if a.count(w) == 1 and b.count(w) == 1]
        places, best = [a.index(w) for w in once], []
        for k, i in enumerate(places):
            best.append(1 + max((best[j] for j in range(k) if places[j] < i), default=0))
        chain = licenses.anchors(a, b)
        assert len(chain) == max(best, default=0)
        assert all(a[i] == b[j] and a.count(a[i]) == b.count(a[i]) == 1 for i, j in chain) and all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(chain))


def test_license_scan_ranks_and_spans(spark):
    bsd = licenses.TEXTS["BSD-2-Clause"]
    data = [(1, "(c) A Company. All\n * rights reserved."), (2, "All rights reserved. " + bsd.replace("BUSINESS", "TRADE")), (3, "Released under the MIT License. " + bsd)]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert (got[1].license, got[1].found[0]["first"], got[1].found[0]["last"]) == (licenses.RESERVED, 3, 5)
    assert [f["license"] for f in got[2].found] == ["BSD-2-Clause", licenses.RESERVED] and got[2].coverage < 1
    assert [f["license"] for f in got[3].found] == ["BSD-2-Clause", "MIT notice"] and (got[3].found[1]["first"], got[3].found[1]["last"]) == (0, 4)


def test_mixing_and_packing_ignore_paths_and_splits(spark, tmp_path):
    """The same rows at another path, in other files: the same result, row by row."""
    data = [(i // 2, " ".join([f"w{i}"] * (3 + i % 2)), f"s{i % 3}") for i in range(240)]
    out = []
    for k, order in enumerate((data, data[::-1])):
        path = f"file://{tmp_path}/{k}"
        spark.createDataFrame(order, "doc_id long, text string, source string").repartition(k + 2).write.parquet(path)
        docs = spark.read.parquet(path)
        plan = mixing.mix_plan(docs).drop("rid")
        out.append([Counter(map(tuple, df.collect())) for df in (plan, mixing.mix(docs), packing.pack(docs, capacity=64))])
    assert any(r[plan.columns.index("copies")] == 1 for r in out[0][0]) and any(r[plan.columns.index("copies")] == 2 for r in out[0][0])
    assert out[0] == out[1]


def test_keep_first_tells_rows_of_one_id_apart(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(60))
    rows = [(3, text("a")), (3, text("b")), (3, text("b")), (5, text("b") + " more"), (None, text("c")), (None, text("d")), (7, None), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = Counter(map(tuple, ngram_join.keep_first(docs, 5, Fraction(4, 5)).collect()))
    assert kept == Counter([(3, text("a")), (3, text("b")), (None, text("c")), (None, text("d")), (7, None), (7, None)])


def test_bitmap_holds_every_row_number(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rids = [int(x) for x in rng.integers(-(1 << 63), (1 << 63) - 1, 3000)]
    rows = spark.createDataFrame([(r, "x") for r in rids], "rid long, text string")
    ids = rows.limit(0).select("rid").unionByName(spark.createDataFrame([(r,) for r in rids[:300]], "rid long"))
    left = {r.rid for r in common.may_be_in(rows, ids).collect()}
    assert set(rids[:300]) <= left and len(left) < 600
    monkeypatch.setattr(common, "BITMAP_BITS", 6)  # a full bitmap spares nothing and loses nothing
    assert set(rids[:300]) <= {r.rid for r in common.may_be_in(rows, ids).collect()}
    assert common.may_be_in(rows, ids.limit(0)).collect() == []


def test_row_numbers_do_not_depend_on_splits(spark, docs):
    numbers = lambda: {r.doc_id: r[common.RID] for r in common.with_rid(docs).select("doc_id", common.RID).collect()}
    before, was = numbers(), spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        assert numbers() == before
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert len(set(before.values())) == len(before) == docs.count()
    own = docs.select("doc_id").withColumn(common.RID, F.col("doc_id") * 10)
    assert {r[common.RID] for r in common.with_rid(own).collect()} == {10 * i for i in before}


def test_without_keeps_all_others(spark, docs, monkeypatch):
    rows = common.with_rid(docs)
    gone = rows.where("doc_id % 3 = 0").select(F.col(common.RID).alias("rid"), "doc_id")
    want = {r.doc_id for r in docs.collect() if r.doc_id % 3}
    for bits in (25, 6):
        monkeypatch.setattr(common, "BITMAP_BITS", bits)
        kept = common.without(rows, gone)
        assert kept.columns == rows.columns and sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_settings_come_back(spark):
    before = {k: spark.conf.get(k, None) for k in common.BOUNDED}
    with pytest.raises(ZeroDivisionError), common.bounded(spark, {"spark.sql.shuffle.partitions": "7"}):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "7"
        raise ZeroDivisionError
    assert {k: spark.conf.get(k, None) for k in common.BOUNDED} == before and spark.conf.get("spark.sql.shuffle.partitions") == "4"
