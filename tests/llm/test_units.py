"""Kernels against brute force."""

import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm import covertree, htmltext, packing, quality, textblocks, topk, toxicity
from marginalia.llm.hyperminhash import jaccard, sketch
from marginalia.llm.lattice import HashTable, Lattice, Pieces
from marginalia.llm.tokens import Encoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
texts = st.lists(st.one_of(st.none(), st.text(alphabet="aAbBé😀 \t\n.,ſ", max_size=40)), max_size=12)


def lowered(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


@given(texts)
@settings(max_examples=150, deadline=None)
def test_words_and_shingles(rows):
    want = [WORD.findall(lowered(t)) for t in rows]
    for lo, hi, raw, offsets in textblocks.blocks(pa.array(rows, pa.string())):
        w = textblocks.words(raw, offsets)
        got = [[] for _ in range(hi - lo)]
        for r, s, e in zip(w.row, w.start, w.end):
            got[r].append(textblocks.LOWER[raw[s:e]].tobytes().decode())
        assert got == want[lo:hi]
        h, row = textblocks.shingles(w, hi - lo, 4)
        sizes = [len({tuple(x[i : i + 4]) for i in range(len(x) - 3)}) if len(x) >= 4 else int(bool(x)) for x in want[lo:hi]]
        assert np.bincount(row, minlength=hi - lo).tolist() == sizes


def test_long_text_is_scanned_in_pieces_alike():
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9))) for _ in range(900_000))
    (block,) = textblocks.blocks(pa.array([text]))
    assert len(block[2]) > 4 * textblocks.BLOCK
    cut = textblocks.words(block[2], block[3], heads=(4,))
    whole = textblocks._scan(textblocks.LOWER[block[2]], block[3], textblocks.SPACE, (4,))
    assert (cut.hashes == whole.hashes).all() and (cut.start == whole.start).all() and (cut.heads[0] == whole.heads[0]).all()


def test_sketch_estimates():
    rng = np.random.default_rng(4)
    for n, share in itertools.product((5, 40, 3000), (0.5, 0.8, 1.0)):
        errors = []
        for _ in range(60):
            both = rng.integers(0, 2**63, n, dtype=np.uint64)
            k = round(n * share)
            a, b = np.sort(both), np.sort(both[:k])
            errors.append(jaccard(sketch(a)[None], sketch(b)[None], np.array([n]), np.array([k]))[0] - k / n)
        assert abs(np.mean(errors)) < 0.03


def test_segments_are_the_maximal_ones():
    rng = random.Random(8)
    for _ in range(200):
        n, other = rng.randint(1, 14), -0.5
        score = [rng.choice([other, other, 1.0, 2.0]) for _ in range(n)]
        place = np.array([i for i, s in enumerate(score) if s > 0])
        if not len(place):
            continue
        found = toxicity.segments(place, np.array([score[i] for i in place]), other)
        best = max(sum(score[i:j]) for i in range(n) for j in range(i + 1, n + 1))
        assert max(s for *_, s in found) == pytest.approx(best)
        assert all(s == pytest.approx(sum(score[a : b + 1])) for a, b, s in found)
        assert all(b < c for (_, b, _), (c, _, _) in itertools.pairwise(found))


def test_lattice_sums_all_segmentations():
    pieces = Pieces([b"a", b"ab", b"b"], np.array([0, 1, 2]), [b"a", b"b", b"ba", b"c"], np.array([3, 4, 5, 6]))
    model = Lattice.initial(pieces)
    start, cont = dict(zip(pieces.start, np.exp(model.log_start))), dict(zip(pieces.cont, np.exp(model.log_cont)))
    go, stop, empty = math.exp(model.log_go), math.exp(model.log_stop), math.exp(model.log_empty)

    def rest(w, first=False):
        if not w:
            return 0.0 if first else stop
        return sum((1 if first else go) * p * rest(w[len(x) :]) for x, p in cont.items() if w.startswith(x))

    words = [b"a", b"ab", b"abba", b"ccab", b"babab"]
    raw = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    begin = end - [len(w) for w in words]
    want = [sum(p * rest(w[len(x) :]) for x, p in start.items() if w.startswith(x)) + empty * rest(w, True) for w in words]
    assert model.log10(raw, begin, end) == pytest.approx(np.log10(want))
    s, c, w = model.expected(raw, begin, end, np.ones(len(words)))
    assert s.sum() == pytest.approx(len(words)) and w == len(words)
    again = model.refit(s, c, w, prior=1e-6)
    assert again.log10(raw, begin, end).sum() > model.log10(raw, begin, end).sum()


def test_hash_table():
    keys = np.random.default_rng(2).integers(0, 2**63, 5000, dtype=np.uint64)
    table = HashTable(keys, 10)  # crowded on purpose
    assert (table.find(keys) == np.arange(5000)).all() and (table.find(keys + np.uint64(1)) == -1).all()


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
@settings(max_examples=200, deadline=None)
def test_plan_fills_without_gaps(counts):
    slots, made = packing.plan(counts, 64)
    at = {}
    for s in slots:
        for k in range(s.count):
            at.setdefault(s.sequence + k, []).append((s.offset, s.length))
    assert len(at) == made
    for own in at.values():
        own.sort()
        assert all(a + n == b for (a, n), (b, _) in itertools.pairwise(own)) and own[0][0] == 0 and sum(own[-1]) <= 64
    for length, n in counts.items():
        ranks = sorted(r for s in slots if s.length == length for r in range(s.rank, s.rank + s.count))
        assert ranks == list(range(n))
    widths, cells = packing.buckets(slots, counts)
    assert len(cells) <= 3 * len(slots)
    for length, n in counts.items():
        for r in range(n):
            assert sum(c[2] <= r < c[2] + c[3] for c in cells if c[:2] == (length, r // widths[length])) == 1
    assert made <= sum(k * v for k, v in counts.items()) / 32 + 1


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_encoder_equals_the_exact_library(text):
    e = Encoder()
    assert e.encode([text])[0].tolist() == [*e.exact.encode(text, add_special_tokens=False).ids, 2]


def test_encoder_specials_and_null():
    e = Encoder()
    assert e.encode([None])[0].tolist() == [2]
    assert e.encode(["a<|endoftext|>b"])[0].tolist() == [*e.exact.encode("a<|endoftext|>b", add_special_tokens=False).ids, 2]


def test_dual_traversal_equals_all_pairs():
    rng = np.random.default_rng(3)
    for d, spread in ((2, 1.0), (3, 0.3), (16, 0.05)):
        base = rng.normal(size=(40, d))
        raw = np.concatenate([base, base[rng.integers(0, 40, 160)] + spread * 0.2 * rng.normal(size=(160, d))])
        x, norm = covertree._unit(raw)
        want = {(i, j) for i, j in np.argwhere(np.triu(x @ x.T >= 0.9, 1)).tolist()}
        for split in (200, 90):
            trees = [covertree.cover(x, np.arange(split), 0, 2.0)] + ([covertree.cover(x, np.arange(split, 200), split, 2.0)] if split < 200 else [])
            got = set()
            for a, b in itertools.combinations_with_replacement(range(len(trees)), 2):
                i, j = covertree.dual(x, [(trees[a], trees[b])], math.sqrt(0.2))
                pairs = [tuple(sorted(p)) for p in zip(i.tolist(), j.tolist()) if x[p[0]] @ x[p[1]] >= 0.9]
                assert len(pairs) == len(set(pairs))
                got |= set(pairs)
            assert got == want


def test_cover_tree_levels_halve():
    x, _ = covertree._unit(np.random.default_rng(1).normal(size=(300, 3)))

    def walk(node, reach):
        assert covertree._distance(x[node.members], x[node.center][None]).max() <= node.radius + covertree.SAFE
        if node.children:
            assert sorted(np.concatenate([c.members for c in node.children]).tolist()) == sorted(node.members.tolist())
            assert all(c.radius <= reach / 2 + 1e-3 for c in node.children)
            for c in node.children:
                walk(c, max(c.radius, reach / 2))

    walk(covertree.cover(x, np.arange(300), 0, 2.0), 2.0)


@pytest.mark.parametrize("kind", [np.int64, np.float64])
def test_no_random_access_top_k(kind):
    rng = np.random.default_rng(5)
    values = rng.integers(-60, 60, (500, 6)).astype(kind)
    lists = topk.Lists(np.arange(500), values)
    for _ in range(60):
        q = rng.integers(-60, 60, 6).astype(kind)
        ids, scores = lists.top(q, 5, None, 7)
        best = sorted((-int(values[i] @ q), i) for i in range(500) if i != 7)[:5]
        got = sorted((-int(s), int(i)) for i, s in zip(ids, scores))[:5]
        assert got == best


def test_top_k_reads_lists_in_order_and_stops():
    class Counted(topk.Lists):
        def read(self, total, lists, weights, begin, end):
            spans.extend([(begin, end)] * bool(len(lists)))
            super().read(total, lists, weights, begin, end)

    values = np.zeros((1000, 4))
    values[:10] = np.arange(1000, 1010)[:, None]  # ten rows lead every list
    lists = Counted(np.arange(1000), values)
    lists.start, spans = 20, []
    ids, scores = lists.top(np.ones(4), 5, None, -1)
    assert set(range(5, 10)) <= set(ids.tolist()) and max(end for _, end in spans) == 20
    lists = Counted(np.arange(1000), np.random.default_rng(1).normal(size=(1000, 4)).round(3))
    lists.start, spans = 20, []
    lists.top(np.ones(4), 5, None, -1)
    assert len(spans) > 1 and spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))  # on from where it stopped
    assert lists.top(np.zeros(4), 5, None, 3)[0].size == 999  # no list to read: all tie


def test_factorisation_machine_identity():
    rng = np.random.default_rng(6)
    m = quality.Machine(0.3, rng.normal(size=quality.FEATURES), rng.normal(size=(quality.FEATURES, 3)), np.zeros(len(quality.STATS)), np.ones(len(quality.STATS)))
    f, v = np.array([3, 9, 40, 77]), rng.normal(size=4)
    pairs = sum(m.factors[a] @ m.factors[b] * x * y for (a, x), (b, y) in itertools.combinations(zip(f, v), 2))
    assert m.margin(np.zeros(4, int), f, v, 1)[0] == pytest.approx(0.3 + m.linear[f] @ v + pairs)


def test_html_blocks_and_noise():
    page = (
        "<html><head><title>T</title><script>var a='</p><p>x';</script></head><body><header>Top</header><nav><a>m</a></nav><div class='cookie-notice'>c</div>"
        "<main><h1>A &amp; B</h1><p>one\n two<br>three <b>x</b>y<p>four &lt;p&gt; &am<aside>s</aside><form>f</form><ul><li>i<li>j</ul><!-- no --><div id='comments'>bad</div></main><footer>f</footer><p"
    )
    assert htmltext.main_text(htmltext.parse(page), set()) == "A & B\n\none two three xy\n\nfour <p> &am\n\ni\n\nj"
    assert htmltext.main_text(htmltext.parse(""), set()) == "" and htmltext.main_text(htmltext.parse("<div>" * 5000 + "x"), set()) == "x"


@pytest.mark.parametrize(
    "page, text",
    [
        ("<body class='has-sidebar'><p>a</p></body>", "a"),
        ("<html class='no-js menu'><body class='sidebar'><p>a</p></body></html>", "a"),
        ("<div id='content' class='no-sidebar'><p>a</p></div>", "a"),
        ("<article class='post comments-open'><p>a</p></article>", "a"),
        ("<article class=comments><p>a</p></article>", "a"),
        ("<div class='share wrap'><div><main>a</main></div></div>", "a"),
        ("<div class='widget'><div role='main' class=promo>a</div></div>", "a"),
        ("<div class='cookie-notice'>c</div><div class='x nav-menu'>c</div><div role=navigation>c</div><div id=ad-12>c</div><p>a</p>", "a"),
        ("<article>a <math><mi>x</mi></math> b</article>", "a x b"),
    ],
)
def test_html_noise_is_whole_names(page, text):
    assert htmltext.main_text(htmltext.parse(page), set()) == text


def test_html_landmarks_are_no_classes():
    root = htmltext.parse("<div class='main-header'>h</div><div class=main-title>t</div><div role='main'>m</div><main>n</main><article>o</article><p>b</p>")
    constant = {e.index for e in root.children}
    assert htmltext.main_text(root, constant) == "m\n\nn\n\no"


def test_tree_matching_aligns_by_order():
    a = htmltext.parse("<div><h1>t</h1><p>1</p><ul><li>x</li></ul><p>2</p></div>")
    b = htmltext.parse("<div><h1>u</h1><ul><li>y</li><li>z</li></ul><p>2</p></div>")
    tags = [(x.tag, y.tag) for x, y in htmltext.align(a, b)]
    assert sorted(tags) == sorted([("#root", "#root"), ("div", "div"), ("h1", "h1"), ("ul", "ul"), ("li", "li"), ("p", "p")])


def brute_match(a, b):
    """Size of the largest order-preserving top-down match, by trying all."""
    if a.label != b.label:
        return 0

    def lists(x, y):
        if not x or not y:
            return 0
        own = brute_match(x[0], y[0])
        return max(lists(x[1:], y), lists(x, y[1:]), own + lists(x[1:], y[1:]) if own else 0)

    return 1 + lists(a.children, b.children)


def test_alignment_is_the_largest_match():
    rng = np.random.default_rng(5)

    def tree(depth):
        tag = "div span b".split()[rng.integers(3)]
        inner = "".join(tree(depth - 1) for _ in range(rng.integers(0, 4))) if depth else ""
        return f"<{tag}>{inner}</{tag}>"

    for _ in range(60):
        a, b = htmltext.parse(tree(3)), htmltext.parse(tree(3))
        pairs = htmltext.align(a, b)
        assert len(pairs) == brute_match(a, b)
        assert all(x.label == y.label for x, y in pairs) and len({x.index for x, _ in pairs}) == len({y.index for _, y in pairs}) == len(pairs)


def test_deep_pages_are_aligned():
    deep = ["<div>" * 5000 + f"<p>text {k}</p>" + "<b>x</b>" * k for k in range(2)]
    pairs = htmltext.align(*(htmltext.parse(p) for p in deep))
    assert len(pairs) == 5002 and htmltext.main_text(htmltext.parse(deep[0]), set()) == "text 0"


def test_a_tag_that_never_ends_is_no_text():
    assert htmltext.main_text(htmltext.parse("<p>a</p><div title='" + "x " * 5000), set()) == "a"
    assert htmltext.main_text(htmltext.parse("<p>a &lt; b 1 < 2</p>"), set()) == "a < b 1 < 2"


def test_crc_of_pieces():
    ids = np.arange(5, dtype="<u4")
    assert zlib.crc32(ids[1:3].tobytes()) == zlib.crc32(b"\x01\0\0\0\x02\0\0\0")


def test_gathered_keeps_rows_and_lattice_counts_do_not_depend_on_batches():
    import random

    from marginalia.llm.columns import gathered

    rng = random.Random(11)
    spelled = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))).encode() for _ in range(700)]
    small = [pa.record_batch({"w": pa.array(spelled[k : k + 10])}) for k in range(0, len(spelled), 10)]
    joined = list(gathered(iter(small), rows=64))
    assert [x for b in joined for x in b.column(0).to_pylist()] == spelled and len(joined) < len(small)
    assert list(gathered(iter([]))) == []
    assert len(list(gathered(iter(small), size=1))) == len(small)

    model = Lattice.initial(Pieces.load())

    def expected(words):
        edge = np.cumsum([0, *map(len, words)])
        return model.expected(np.frombuffer(b"".join(words), np.uint8), edge[:-1], edge[1:], np.ones(len(words)))

    whole, parts = expected(spelled), [expected(b.column(0).to_pylist()) for b in small]
    for at in (0, 1, 2):
        assert np.allclose(whole[at], sum(p[at] for p in parts))


def test_lattice_of_long_words_goes_arc_by_arc_alike(monkeypatch):
    from marginalia.llm import lattice as module

    model, spelled = Lattice.initial(Pieces.load()), [w.encode() for w in ("retitioning" * 9, "über", "x", "aaaa" * 9)]
    raw, end = np.frombuffer(b"".join(spelled), np.uint8), np.cumsum([len(w) for w in spelled])
    begin = end - [len(w) for w in spelled]
    one = model.log10(raw, begin, end), *model.expected(raw, begin, end, np.arange(1.0, 5.0))
    monkeypatch.setattr(module, "LONG", 2)
    two = model.log10(raw, begin, end), *model.expected(raw, begin, end, np.arange(1.0, 5.0))
    assert all(np.allclose(a, b) for a, b in zip(one, two, strict=True))
