"""Null ids, repeated rows, one id with two texts, and empty tables: the results that the docstrings define."""

import pytest

from graphloom.llm import exact_dedup, licenses, mixing, ngram_join, packing, quality, sharding, substring, tokens, warc

OPERATORS = {
    "substring": substring.substring_dedup, "tokens": tokens.token_counts, "packing": packing.pack, "sharding": lambda d: sharding.assign(d, "doc_id"), "quality": quality.quality,
    "keep_good": quality.keep_good, "mixing": mixing.mix_plan, "mix": mixing.mix, "licenses": licenses.license_scan, "ngram_join": ngram_join.jaccard_components,
    "keep_first": ngram_join.keep_first, "exact": exact_dedup.exact_dedup, "keep_one": exact_dedup.keep_one,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(no_docs, name):
    assert OPERATORS[name](no_docs).collect() == []


def test_empty_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(warc.archive(pages, f"file://{tmp_path}/a")).collect() == []


@pytest.mark.parametrize("name", ["substring", "tokens", "packing", "sharding", "quality", "mixing", "licenses", "ngram_join", "exact"])
def test_a_row_for_each_row(odd_docs, name):
    assert OPERATORS[name](odd_docs).count() == odd_docs.count()


def test_substring_odd(odd_docs):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed) for r in substring.substring_dedup(odd_docs).collect())
    # the null id is the smallest and keeps its text; all later copies lose theirs
    assert got == [(-1, 0, 0), (-1, 80, 0), (1, 80, 80), (1, 80, 80), (1, 81, 80), (2, 80, 80), (3, 0, 0), (3, 0, 0)]


def test_exact_odd(odd_docs):
    rows = exact_dedup.exact_dedup(odd_docs).collect()
    assert sorted((str(r.doc_id), r.keep_id, r.group_size, r.kept) for r in rows if r.group_size == 4) == [("1", 2, 4, False), ("1", 2, 4, False), ("2", 2, 4, True), ("None", 2, 4, False)]
    empty = [r for r in rows if r.keep_id == 3]
    assert len(empty) == 3 and sum(r.kept for r in empty) == 1
    assert sorted(r.doc_id for r in exact_dedup.keep_one(odd_docs).collect()) == [1, 2, 3]


def test_ngram_join_odd(odd_docs):
    rows = ngram_join.jaccard_components(odd_docs).collect()
    # all long texts are one component, whose smallest id is the null; texts without words stay alone
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in rows) == [("1", 78, None), ("1", 78, None), ("1", 79, None), ("2", 78, None), ("3", 0, 3), ("3", 0, 3), ("None", 0, None), ("None", 78, None)]


def test_mixing_odd(odd_docs):
    rows = mixing.mix_plan(odd_docs).collect()
    assert {r.source_size for r in rows if r.source is None} == {160}
    assert all(r.taken <= 2 * r.size for r in rows)


def test_warc_odd(spark, tmp_path):
    pages = spark.createDataFrame([(None, None, "x" * 50), (1, "u", "x" * 50), (1, "u", "x" * 50), (2, "u", None), (3, "u", "")], "page_id long, url string, html string")
    got = sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes) for r in warc.read(warc.archive(pages, f"file://{tmp_path}/a")).collect())
    assert got == [("1", "response", None, 50), ("1", "revisit", 1, 50), ("2", "revisit", 3, 0), ("3", "response", None, 0), ("None", "revisit", 1, 50)]


def test_pipeline_runs_on_clashing_and_odd_columns(spark, docs, odd_docs, tmp_path):
    import corpus_pipeline

    for k, frame in enumerate((docs, odd_docs.selectExpr("doc_id", "text", "source", "'x' as rid", "1 as size"))):
        kept = {r.doc_id for r in frame.collect()}
        for name, stage in corpus_pipeline.STAGES:
            path = f"{tmp_path}/{k}-{name}"
            out = stage(spark, frame, str(tmp_path))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == frame.columns
            out.write.parquet(path)
            frame = spark.read.parquet(path)
            assert {r.doc_id for r in frame.select("doc_id").collect()} <= kept


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_pipeline_against_brute_force(spark, rows, tmp_path):
    """Each stage's rows from its input alone, by plain Python; run() gives what the stages in turn give."""
    from collections import Counter, defaultdict
    from fractions import Fraction

    import corpus_pipeline
    from test_contracts import brute_components, library, repeat_mask, shingle_sets, words

    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    now, frame, got = [(i, t, s) for i, t, s in rows], spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frame, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        got[name] = frame.collect()
        if name == "best_fit_packing":
            break
        mine = [(r.doc_id, r.text, r.source) for r in got[name]]
        if name == "quality_rules":
            rules, want = quality.Rules(), []
            for i, t, s in now:
                w, lines = words(t), Counter(x for x in (t or "").split("\n") if words(x))
                chars = max(1, sum(map(len, w)))
                dup = sum((n - 1) * sum(map(len, words(x))) for x, n in lines.items())
                bad = len(w) < 20 or 100 * len(repeat_mask(w, 8)) > 30 * len(w) or dup > rules.max_dup_line_chars * chars or sum(c in "#*$%&|<>" for c in t or "") > rules.max_symbol_chars * chars
                if not bad and all(sum(len(w[p]) for p in repeat_mask(w, n)) <= limit * chars for n, limit in rules.ngram_limits):
                    want.append((i, t, s))
        elif name == "exact_dedup":
            last = {}
            for i, t, s in now:
                last[t or ""] = max(last.get(t or "", (-1,)), (i, t, s))
            want = list(last.values())
        elif name == "ngram_jaccard_join":
            component = brute_components(shingle_sets(now, 5), Fraction(4, 5))
            want = [x for x in now if component[x[0]] == x[0]]
        elif name == "source_mix":
            size = Counter()
            for _, t, s in now:
                size[s] += len(words(t))
            target = {t.source: t.target for t in mixing.targets(list(size.items()))}
            taken, copies = Counter(), Counter(mine)
            for (_, t, s), n in copies.items():
                assert n <= 2
                taken[s] += n * len(words(t))
            longest = {s: max(len(words(t)) for _, t, x in now if x == s) for s in size}
            assert all(abs(taken[s] - target[s]) <= longest[s] for s in size) and set(mine) <= set(now)
            want = mine
        assert Counter(mine) == Counter(want), name
        now = want
    lib, bins, pieces = library(), defaultdict(list), Counter()
    for r in got["best_fit_packing"]:
        bins[r.sequence_id].append((r.offset, r.length))
        pieces[(r.doc_id, r.piece, r.start, r.length)] += 1
    want = Counter()
    for i, t, _ in now:
        n, at, k = len(lib.encode(t, add_special_tokens=False).ids) + 1, 0, 0
        while at < n:
            size = n - at - 2048 * ((n - at - 1) // 2048)
            want[(i, k, at, size)] += 1
            at, k = at + size, k + 1
    assert pieces == want
    assert all(sum(n for _, n in b) <= 2048 and sorted(o for o, _ in b) == [sum(n for o, n in b if o < x) for x in sorted(o for o, _ in b)] for b in bins.values())
    key = lambda rs: Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rs)
    assert key(corpus_pipeline.run(spark, str(tmp_path)).collect()) == key(got["best_fit_packing"])


@pytest.fixture(scope="module")
def long_docs(spark, tmp_path_factory):
    """Texts of 200 000 words, one without a single blank, one of CJK, beside short ones; written as Parquet."""
    import numpy as np

    rng = np.random.default_rng(21)
    words = [f"w{x}" for x in rng.integers(0, 10**6, 200_000)]
    near = [w if k % 5000 else f"edit{k}" for k, w in enumerate(words)]
    cjk = "".join(rng.choice(list("天地玄黄宇宙洪荒日月盈昃。，"), 300_000))
    license_text = licenses.TEXTS["MIT"].replace("*", "")
    texts = [" ".join(words), " ".join(near) + " " + license_text, "x" * 2_000_000, cjk, "short text", " ".join(words), "0123456789abcdef" * 60_000]
    path = str(tmp_path_factory.mktemp("long") / "documents.parquet")
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(path)
    return spark.read.parquet(path), texts


def test_very_long_texts(spark, long_docs, tmp_path):
    import hashlib

    from tokenizers import Tokenizer

    docs, texts = long_docs
    lib = Tokenizer.from_file(tokens.tokenizer_path())
    n_tokens = [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]
    assert [r.n_tokens for r in tokens.token_counts(docs).orderBy("doc_id").collect()] == n_tokens
    pieces = packing.pack(docs).collect()
    assert sum(p.length for p in pieces) == sum(n_tokens) + len(texts) and len(pieces) == sum(-(-(n + 1) // 2048) for n in n_tokens)
    q = quality.quality(docs).orderBy("doc_id").collect()
    assert [r.n_words for r in q] == [len(t.split()) for t in texts] and [r.word_chars for r in q] == [sum(map(len, t.split())) for t in texts]
    exact = exact_dedup.exact_dedup(docs).orderBy("doc_id").collect()
    assert [r.keep_id for r in exact] == [5, 1, 2, 3, 4, 5, 6] and [r.text_sha256 for r in exact] == [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    assert [r.component_id for r in ngram_join.jaccard_components(docs).orderBy("doc_id").collect()] == [0, 0, 2, 3, 4, 0, 6]
    cut = substring.substring_dedup(docs).orderBy("doc_id").collect()
    assert (cut[0].n_removed, cut[5].n_removed, cut[4].n_removed) == (0, 200_000, 0)
    edits = [k for k in range(200_000) if k % 5000 == 0]
    assert cut[1].n_removed == 200_000 - len(edits)
    found = licenses.license_scan(docs).orderBy("doc_id").collect()
    assert [r.license for r in found] == [None, "MIT", None, None, None, None, None] and found[1].found[0]["first"] >= 200_000
    assert [r["size"] for r in mixing.mix_plan(docs).orderBy("doc_id").collect()] == [len(t.split()) for t in texts]
    assert sharding.assign(docs, "doc_id").count() == len(texts)
    pages = docs.selectExpr("doc_id as page_id", "'u' as url", "text as html")
    got = warc.read(warc.archive(pages, f"file://{tmp_path}/w")).orderBy("page_id").collect()
    assert [r.record_type for r in got] == ["revisit", *["response"] * 6] and all(bytes(r.payload).decode() == texts[r.page_id] for r in got[1:])


def test_null_ids_and_repeats_in_row_wise_operators(odd_docs):
    """Operators that judge each row by itself give equal rows for equal texts, and ids as they were."""
    want = {(r.doc_id, r.text) for r in odd_docs.collect()}
    size = lambda t: len((t or "").split())
    assert sorted(r.n_words for r in quality.quality(odd_docs).collect()) == sorted(r.n_words for r in licenses.license_scan(odd_docs).collect()) == sorted(size(r.text) for r in odd_docs.collect())
    for rows in (quality.quality(odd_docs).collect(), licenses.license_scan(odd_docs).collect(), tokens.token_counts(odd_docs).collect(), packing.pack(odd_docs).collect(), sharding.assign(odd_docs, "doc_id").collect()):
        assert {r.doc_id for r in rows} == {i for i, _ in want}
    counts = tokens.token_counts(odd_docs).collect()
    assert {(r.doc_id, r.n_bytes) for r in counts} == {(i, len(t or "")) for i, t in want}
