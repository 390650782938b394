"""Embedding links, HTML text and WARC archives against brute force, and the pipeline stage by stage."""

import gzip
import hashlib
import os
import random
import re
import time
from collections import Counter
from urllib.parse import urlparse

import numpy as np
import public_tokenizers
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from gaugeworks.llm import bpe, embedding_dedup, html_text, quality, queries, warc
from tests.check import compare
from tests.llm.test_text_operators import SMALL, components_by_hand, dedup_by_hand, library, statistics_by_hand

# ---- embeddings


def links_by_hand(rows, least=0.93):
    good = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    up = {r[0]: r[0] for r in rows if r[0] is not None}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    n = [0] * len(rows)
    for i, (a, v, x) in enumerate(rows):
        for j in range(i):
            b, w, y = rows[j]
            if None in (a, b, x, y) or x != y or not good(v) or not good(w) or len(v) != len(w):
                continue
            v64, w64 = np.array(v, float), np.array(w, float)
            if v64 @ w64 / (np.linalg.norm(v64) * np.linalg.norm(w64)) >= least:
                n[i], n[j] = n[i] + 1, n[j] + 1
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return Counter((r[0], k, None if r[0] is None else find(r[0])) for r, k in zip(rows, n))


def vectors(seed, dim=64):
    random_ = np.random.RandomState(seed)
    centres = random_.normal(size=(40, dim))
    rows = []
    for i in range(300):
        c = centres[random_.randint(0, 40 if i % 2 else 3)]
        # cosines on both sides of the threshold
        v = c + random_.normal(size=dim) * random_.choice([0.02, 0.15, 0.28, 0.4])
        rows.append((i, [float(np.float32(x)) for x in v * random_.choice([1e-3, 1, 50])], int(random_.randint(2))))
    rows += [(400 + k, rows[7][1], rows[7][2]) for k in range(30)] + rows[:2]
    rows += [(500, None, 1), (501, [], 1), (502, [0.0] * dim, 1), (503, [float("nan")] + [1.0] * (dim - 1), 1), (None, rows[7][1], rows[7][2])]
    rows += [(504, [None] + [1.0] * (dim - 1), 1), (505, [float("inf")] * dim, 1), (506, rows[7][1], None), (507, [1.0, 2.0], 1), (508, [2.0, 4.0], 1)]
    return rows


@pytest.mark.parametrize("seed, cell_rows", [(1, 512), (2, 16)])
def test_embedding_links(spark, seed, cell_rows):
    rows = vectors(seed)
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, embedding array<float>, label int, h1 int, rep int")
    found = embedding_dedup.link_vectors(df, cell_rows=cell_rows).collect()
    want = links_by_hand(rows)
    linked = sum(n * c for (_, n, _), c in want.items())
    got = Counter((r.vec_id, r.n_links, r.component_id) for r in found)
    assert sum(n * c for (_, n, _), c in got.items()) >= 0.995 * linked > 1000
    assert sum((got & want).values()) >= 0.97 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found if r.vec_id is not None)
    assert embedding_dedup.link_vectors(df.limit(0)).count() == 0


def test_list_decoding_finds_every_filter():
    code = embedding_dedup.ProductCode(10, 3, 6, 20, 1)
    unit = np.random.RandomState(4).normal(size=(20, 10))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    a, b, c = code.scores(unit)
    for v, found in enumerate(code.decode(unit)):
        every = (a[v][:, None, None] + b[v][None, :, None] + c[v]).ravel()
        want = every >= code.threshold
        sure = np.abs(every - code.threshold) > 1e-9  # sums in another order may differ in the last digit
        got = np.isin(np.arange(len(every)), found)
        assert (got == want)[sure].all()


@pytest.mark.parametrize("dim", [1, 2, 3, 4, 5, 6, 8, 11, 12, 64])
def test_linked_pairs_meet_in_a_filter(dim):
    own = embedding_dedup
    codes = own.product_codes(dim, own.BLOCKS, own.CODEWORDS, own.CODES, own.FILTERS_PER_VECTOR, 0.93, 7)
    for cosine in (0.931, 0.97, 0.999):
        random_ = np.random.RandomState(dim)
        one, other = own.unit_rows(random_.normal(size=(500, dim))), random_.normal(size=(500, dim))
        if dim > 1:
            other -= (other * one).sum(axis=1)[:, None] * one
            two = cosine * one + np.sqrt(1 - cosine**2) * own.unit_rows(other)
        else:
            two = one
        met = [len(np.intersect1d(f, g)) > 0 for f, g in zip(own.decode_all(codes, one), own.decode_all(codes, two))]
        assert np.mean(met) >= 0.99


# ---- pages


def test_html_text(spark):
    rows = [
        (0, "u", "<html><head><title>T</title></head><body><nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p><b>one\n two<br><p>To."
         "</p><script>var a='<p>x</p>'</script><div class='ad'>Buy it.</div><p>a&nbsp;b &lt;c&gt; &#233;</p></article><footer>&copy; x</footer>"),
        (1, None, None),
        (2, "", ""),
        (3, "u", "no markup at all, only a few words"),
        (4, "u", "<article><p>" + "word " * 50_000 + "</p></article>"),
        (4, "u", "<nav><a>x</a></nav>"),
        (None, "v", "<main><p title='a > b'>Quoted.<!-- <p>gone</p> --><aside>Read more</aside><form>Name <input></form></main><style>p{}</style"),
        (6, "w", "<article><p>Text.</p><section id=comments><p>I think so too.</p></section></article><div class=cookie-banner>We use cookies.</div>"),
    ]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, n_chars int, Text string")
    found = [(r.page_id, r.text, r.n_chars) for r in html_text.extract(df).collect()]
    texts = ["A & B\none two\nTo.\na b <c> é", "", "", "no markup at all, only a few words", " ".join(["word"] * 50_000), "", "Quoted.", "Text."]
    assert found == [(r[0], t, len(t)) for r, t in zip(rows, texts)]
    assert html_text.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page, texts",
    [
        ("<html><head><title>x</title><body><article><p>One.<p>Two.</article>", ["One.", "Two."]),
        ("<html><head><title>x</title><meta charset=utf-8><article><p>One.</article>", ["One."]),
        ("<p>One.<script>for(var i=0;i<n;i++){f()}</script><p>Two.<script>g()</script>", ["One.", "Two."]),
        ("<head><style>a<b{}</style><script>if(a<b)c('</p>')</SCRIPT ></head><p>One.", ["One."]),
        ("<p>One.<script><!-- a </script><p>Two.", ["One.", "Two."]),
        ("<p>One.<script><!-- w('<script>x</script>') //--></script><p>Two.<textarea>a <b </textarea><p>Three.", ["One.", "Two.", "Three."]),
        ("<datalist><option>a<option>b</datalist><p>One.<select><option>c<option>d</select><p>Two.", ["One.", "Two."]),
        ("<svg><title>t</title><style/><text>a</text></svg><p>One.<canvas><p>Two.", ["One.", "Two."]),
    ],
)
def test_unseen_elements_end(page, texts):
    assert [text for text, _ in html_text.blocks(page)] == texts


_SAID = "This paragraph has a number of words, so that it is as long as text usually is, and then it ends."


@pytest.mark.parametrize(
    "page",
    [
        f"<div class='has-sidebar'><article><h1>+ T</h1><p>+ {_SAID}<p>+ No.</article><div class=sidebar><p>{_SAID}</div></div>",
        f"<form action=/><main><p>+ {_SAID}<p>+ No.<form><p>{_SAID}</form><aside>{_SAID}</aside></main><p>{_SAID}</form>",
        f"<div class='content no-comments'><article><p>+ {_SAID}</article><ol class=comments><li><article><p>{_SAID} {_SAID}</article></ol></div>",
        f"<article><p>+ {_SAID}</article><div class=related><article><p>{_SAID} {_SAID}</article></div>",
        f"<div class='has-sidebar'><div class=promo><article><p>{_SAID}</article></div><article><p>+ {_SAID}</article></div>",
        f"<main><div class='has-sidebar'><article><p>+ {_SAID}<div class=ad>Buy it.</div><p>+ No.</article></div></main>",
        f"<main><p>+ {_SAID} {_SAID}</p><div id=comments><article><p>{_SAID}</article><article><p>{_SAID}</article></div></main>",
        f"<aside><article><p>{_SAID}</article></aside><p>+ {_SAID}",
    ],
)
def test_wrappers_do_not_set_articles_aside(page):
    found = html_text.blocks(page)
    main = html_text.train().predict(html_text.features([own for _, own in found]))
    assert main.tolist() == [text.startswith("+ ") for text, _ in found]


def _renamed(page):
    """The same page with ``div`` for every region and no telling names."""
    return re.sub(r"<(/?)(?:nav|article|footer|aside|header|section|main)\b", r"<\1div", page).replace('class="', 'class="z')


def test_words_and_links_decide_where_nothing_is_named(spark):
    """Without numbers of words and links the tree falls apart; names are one feature of eight."""
    x, y = html_text.labelled()
    tree = html_text.DecisionTree(x, y)
    assert len(y) > 1000 and {0, 1} <= tree.used() and tree.used() & {2, 3, 4, 5}
    assert (tree.predict(x) == y).mean() > 0.99
    blind = x.copy()
    blind[:, :6] = 0
    ablated = html_text.DecisionTree(blind, y)
    unnamed = x[:, 7] == 0
    assert (ablated.predict(blind) != tree.predict(x))[unnamed].mean() > 0.3
    pages = [r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").orderBy("page_id").limit(60).collect()]
    kept = dropped = changed = 0
    for page in pages:
        main = {text for text, own in html_text.blocks(page) if own[3]}
        found = html_text.blocks(_renamed(page))
        own = html_text.features([f for _, f in found])
        assert not own[:, 7].any()
        said = tree.predict(own)
        own[:, :6] = 0
        changed += (ablated.predict(own) != said).sum()
        kept += sum(len(t) for (t, _), k in zip(found, said) if k and t in main)
        dropped += sum(len(t) for t in main) - sum(len(t) for (t, _), k in zip(found, said) if k and t in main)
        assert not any(k for (t, f), k in zip(found, said) if f[1] == 1 and f[0] <= 3)  # menus
    assert kept > 10 * dropped and changed > len(pages)


@pytest.mark.parametrize(
    "page",
    [
        "<a" * 500_000,
        "if a<b then " * 90_000,
        'x <b " ' * 150_000,
        "<p class='" * 100_000,
        "<a \"'> '" * 140_000,
        "<form>" * 170_000,
        "<div>" * 100_000 + "</section>" * 100_000,
        "<script>" + "</script " * 120_000,
        "<script><!--" + "<script " * 120_000,
        "<button>" * 130_000,
        "&#" + "9" * 1_000_000 + ";",
        "&#" + "0" * 1_000_000 + "65;",
        "<!--" * 250_000,
        "<svg><p>" * 120_000,
    ],
)
def test_a_megabyte_of_broken_markup_takes_time_in_proportion(page):
    begin = time.process_time()
    html_text.blocks(page[: len(page) // 4])
    quarter = time.process_time() - begin
    html_text.blocks(page)
    whole = time.process_time() - begin - quarter
    assert whole < 12 * quarter + 1 and whole < 10


def test_references_beyond_all_characters():
    assert html_text.blocks("<p>&#99999999999;a &#0065; &#x41; &#1114112; b") == html_text.blocks("<p>\ufffda A A \ufffd b")


def test_articles_of_the_test_pages(spark):
    """The markup of these pages is simple enough to cut out the article by hand."""
    import html

    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    texts = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        inside = re.search("<article>(.*)</article>", r.html, re.S)[1]
        parts = (" ".join(html.unescape(re.sub("<[^>]+>", "", p)).split()) for p in re.split("</?(?:p|h1)>", inside))
        assert texts[r.page_id] == "\n".join(p for p in parts if p)


def archive_rows():
    rng = random.Random(6)
    rows = [(i, f"https://h{i % 7}.example/{i}", "".join(rng.choice("ab<é>\r\n") for _ in range(rng.randint(0, 400)))) for i in range(200)]
    rows += [(300 + i, f"https://x/{i}", rows[11][2] + "z" * 100) for i in range(40)] + [(500 + i, None, "short") for i in range(5)]
    return rows + [(700, "a\r\nb: c", None), (701, "", ""), (702, "http://é/%41?a b\u00a0\x00", "odd url"), (703, "100%", "x"), (None, "n", "y" * 200), (None, "n", "y" * 200), (310, "again", rows[11][2] + "z" * 100)]


def archive_by_hand(rows):
    first, found = {}, Counter()
    for i, _, text in rows:
        if i is not None:
            first[text] = min(first.get(text, i), i)
    held = set()
    for i, _, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (text or "").encode()
        refers = first.get(text) if len(raw) >= 100 else None
        refers = None if refers is None or (refers == i and text not in held) else refers
        held.add(text)
        found[i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if refers is None else "revisit", refers] += 1
    return found


@pytest.mark.parametrize("range_bytes, roll_bytes", [(1 << 24, 1 << 26), (6000, 2500)])
def test_warc_round_trip(spark, tmp_path, range_bytes, roll_bytes):
    rows = archive_rows()
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "page_id long, url string, html string, id int, digest int").repartition(4)
    sums = []
    for attempt in ("a", "b"):
        folder = f"file://{tmp_path}/{attempt}"
        manifest = warc.write_archive(df, folder, range_bytes=range_bytes, roll_bytes=roll_bytes).orderBy("shard", "part").collect()
        sums.append([(m.path, m.records, m.bytes, m.sha256) for m in manifest])
        names = {n for n in os.listdir(tmp_path / attempt) if n != "manifest" and not n.endswith(".crc")}
        assert names == {m.path for m in manifest}
        # each file is what a plain gzip reader expects, and has the size and digest in the manifest
        for m in manifest:
            raw = (tmp_path / attempt / m.path).read_bytes()
            assert (len(raw), hashlib.sha256(raw).hexdigest()) == (m.bytes, m.sha256)
            assert gzip.decompress(raw).count(b"WARC/1.1\r\nWARC-Type: ") == m.records + 1
        df = df.repartition(7)
    assert sums[0] == sums[1] and sum(m[1] for m in sums[0]) == len(rows)
    assert (len(sums[0]) > 10) == (roll_bytes < 1 << 20)
    found = warc.read_archive(spark, f"file://{tmp_path}/a").collect()
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found)
    assert got == archive_by_hand(rows)
    assert Counter(r.url for r in found) == Counter(r[1] for r in rows)
    texts = Counter((r[0], (r[2] or "").encode()) for r in rows)
    assert not Counter((r.page_id, bytes(r.payload)) for r in found if r.record_type == "response") - texts


def test_files_end_by_compressed_size_at_production_parameters(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, "u", rng.randbytes(600_000).hex()) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = warc.write_archive(df, f"file://{tmp_path}/w").orderBy("shard", "part").collect()
    assert [m.shard for m in manifest] == [0, 0] and sum(m.records for m in manifest) == 40
    assert warc.ROLL_BYTES <= manifest[0].bytes < warc.ROLL_BYTES + 1_300_000 < warc.RANGE_BYTES
    assert warc.read_archive(spark, f"file://{tmp_path}/w", payloads=False).count() == 40


def test_ranges_have_as_many_bytes_and_a_bounded_sample():
    rng = np.random.default_rng(1)
    ids = rng.permutation(10_000).astype(np.int64)
    sizes = rng.integers(1, 2000, 10_000)
    sizes[ids == 77] = 3_000_000
    bounds = warc.range_bounds(ids, sizes, 8)
    held = np.bincount(np.searchsorted(bounds, ids, side="right"), weights=sizes)
    assert len(bounds) == 7 and sorted(held)[-2] < 1.3 * sizes.sum() / 8
    assert len(warc.range_bounds(ids[:0], sizes[:0], 8)) == 0
    assert warc.SAMPLE_ROWS == 200_000  # at any number of pages


@pytest.mark.parametrize(
    "uri, renamed", [("s3a://b/x", "s3://b/x"), ("file:/tmp/x", "file:///tmp/x"), ("file:///x", "file:///x"), ("hdfs://n:9000/x", "hdfs://n:9000/x")]
)
def test_shared_folders_have_names_that_tasks_know(uri, renamed):
    assert warc._renamed(uri) == renamed


def test_warc_of_nothing_and_broken_archives(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(empty).count() == 0
    folder = f"file://{tmp_path}/w"
    warc.write_archive(spark.createDataFrame([(1, "u", "x" * 500)], "page_id long, url string, html string"), folder)
    assert urlparse(folder).scheme == "file" and warc.read_archive(spark, folder).count() == 1
    file = next(p for p in (tmp_path / "w").glob("*.gz"))
    file.write_bytes(file.read_bytes()[:-30])
    with pytest.raises(Exception, match="ends within a record"):
        warc.read_archive(spark, folder).collect()


# ---- queries and pipeline


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(spark, name):
    assert compare(spark, name, SMALL) is None


def test_every_operator_has_a_query():
    numbers = [int(re.match(r"op(\d+)_", name)[1]) for name in contract.queries() if name.startswith("op")]
    assert sorted(numbers) == list(range(1, 14)) and "pipeline" in contract.queries()


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").cache()
    rows = lambda df: [(r.doc_id, r.text, r.lang, r.source) for r in df.collect()]
    (_, rules), (_, lines), (_, near), (_, mix), (_, encode) = corpus_pipeline.STAGES

    judged = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    good = rules(spark, docs, SMALL).cache()
    assert good.columns == docs.columns and {r[0] for r in rows(good)} == {d for d, kept in judged.items() if kept}
    for doc, text, *_ in rows(docs):
        n, _, _, _, again = statistics_by_hand(text)
        assert not (judged[doc] and (n < 20 or 100 * again > 30 * n))

    deduped = lines(spark, good, SMALL).cache()
    by_hand = dedup_by_hand(rows(good))
    assert deduped.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in deduped.collect()) == Counter((d, t) for d, _, _, t in by_hand.elements())
    assert all(r.n_chars == len(r.text) for r in deduped.collect())

    single = near(spark, deduped, SMALL).cache()
    want = {d for d, _, c in components_by_hand(rows(deduped), 5, 4, 5) if d == c}
    assert single.columns == docs.columns and {r.doc_id for r in single.collect()} == want

    mixed = mix(spark, single, SMALL).cache()
    assert mixed.columns == docs.columns and max(Counter(r.doc_id for r in mixed.collect()).values()) <= 2
    have = {r.doc_id: r.text for r in single.collect()}
    assert all(have[r.doc_id].startswith(r.text) and r.text for r in mixed.collect())

    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    want = Counter((r.doc_id, len(library(r.text)[0]), sha(r.text.encode())) for r in mixed.collect())
    assert Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in encode(spark, mixed, SMALL).collect()) == want
    whole = contract.queries()["pipeline"](spark, SMALL)
    assert Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in whole.collect()) == want


def test_vocabulary_is_named_by_path():
    assert bpe.Vocabulary(public_tokenizers.path(queries.VOCABULARY)).special == "<|endoftext|>"
