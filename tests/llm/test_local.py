"""Parts that need no Spark: anchors, signature trees, windows of the network, page rules, features."""

import pickle
import random
from fractions import Fraction

import numpy as np
import pytest

from filigree.llm import anchors, attention_lm, jaccard, language, pages, repeats, words


def test_word_hashes_follow_the_words():
    text = "Ab cd\tab\x0bcd \xe9t\xe9 x" + "y" * 9000
    data = text.encode().lower()
    starts, ends = words.spans(data, words.SPACED)
    assert [data[a:b] for a, b in zip(starts, ends)] == data.split()
    h = words.word_hashes(data).tolist()
    assert h[0] == h[2] and h[1] == h[3] and len(set(h)) == 4
    assert words.word_hashes(b"").size == words.word_hashes(b" \n").size == 0


def test_short_texts_are_one_shingle():
    h = words.word_hashes(b"a b c")
    assert len(words.shingles(h, 5)) == 1 and len(words.shingles(h[:0], 5)) == 0
    assert len(words.shingles(words.word_hashes(b"a a a a a a a"), 5)) == 1


def test_equal_windows_have_equal_anchors():
    rng = random.Random(1)
    values = words.mix(np.array([rng.randrange(3) for _ in range(400)], np.uint64))
    width, reach, gram = 12, 6, 2
    found = anchors.records(values, width, reach, gram)
    assert found.low[0] == 0 and found.high[-1] == len(values) - width
    assert (found.low[1:] == found.high[:-1] + 1).all()
    place = {}
    for low, high, at in zip(*(x.tolist() for x in found)):
        for p in range(low, high + 1):
            assert 0 <= at - p < reach
            assert place.setdefault(values[p : p + width].tobytes(), at - p) == at - p
    assert not len(anchors.records(values[: width - 1], width, reach, gram).low)


def test_range_hashes_do_not_depend_on_the_place():
    values = words.mix(np.array([1, 2, 3, 1, 2, 3, 4], np.uint64))
    h = anchors.Hasher(values, words.SEEDS[0])
    a, b = np.array([0, 3, 0]), np.array([3, 6, 4])
    x, y, z = h.of(a, b).tolist()
    assert x == y != z


def test_multikey_order_is_lexicographic():
    rng = np.random.default_rng(2)
    columns = [rng.integers(0, 4, 300) for _ in range(4)]
    got = list(zip(*(c[repeats.multikey_order(columns)].tolist() for c in columns)))
    assert got == sorted(zip(*(c.tolist() for c in columns)))


def _sets(rng, families=6, members=7):
    out = []
    for _ in range(families):
        base = rng.sample(range(1 << 30), rng.choice((3, 8, 40, 120)))
        for _ in range(members):
            keep = [x for x in base if rng.random() > 0.06]
            out.append(keep + rng.sample(range(1 << 30), rng.randrange(1 + len(base) // 12)))
    return [np.unique(words.mix(np.array(s or [1], np.uint64))) for s in out]


def _similar(a, b):
    common = len(np.intersect1d(a, b))
    return 100 * common >= 80 * (len(a) + len(b) - common)


@pytest.mark.parametrize("seed", range(6))
def test_similar_sets_share_a_node_and_trees_link_exactly(seed):
    sets = _sets(random.Random(seed))
    levels = jaccard.Levels(Fraction(4, 5))
    for common in (np.zeros(1 << 20, bool), np.random.default_rng(seed).random(1 << 20) < 0.4):
        keys = [{(level, k) for level, own in levels.node_keys(s, common) for k in own.tolist()} for s in sets]
        for i in range(len(sets)):
            for j in range(i):
                assert not _similar(sets[i], sets[j]) or keys[i] & keys[j]
    label = jaccard.link_tile(sets, np.arange(len(sets)), Fraction(4, 5))
    want = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if _similar(sets[i], sets[j]) and want[i] != want[j]:
                want = [want[i] if w == want[j] else w for w in want]
    same = lambda x: [[a == b for b in x] for a in x]
    assert same(label.tolist()) == same(want)


@pytest.mark.parametrize("seed", range(4))
def test_similar_sets_share_as_many_nodes_as_either_of_them_says(seed):
    sets = _sets(random.Random(seed))
    levels = jaccard.Levels(Fraction(4, 5))
    for common in (np.zeros(1 << 20, bool), np.random.default_rng(seed).random(1 << 20) < 0.4):
        nodes = [{level: (set(own.tolist()), least) for level, own, least in levels.nodes(s, common)} for s in sets]
        for i in range(len(sets)):
            for j in range(i):
                both = [k for k in nodes[i] if k in nodes[j]]
                if _similar(sets[i], sets[j]):
                    assert any(len(nodes[i][k][0] & nodes[j][k][0]) >= max(nodes[i][k][1], nodes[j][k][1]) for k in both)


def test_every_slot_is_scored_once():
    for n in (1, 2, 23, 24, 25, 43, 44, 45, 64, 80, 500):
        slots = np.arange(n) % attention_lm.SLOTS
        x, y, scored = attention_lm.cut_windows(slots)
        assert y[scored].tolist() == slots.tolist()
        assert x[scored].tolist() == [attention_lm.SLOTS, *slots[:-1].tolist()]


def _network():
    counts = np.random.default_rng(0).integers(0, 50, 3000).astype(float)
    slot, within, shares = attention_lm.slots_of(counts)
    net = attention_lm.Network.start(shares)
    net.theta[:] += np.random.default_rng(1).normal(0, 0.3, len(net.theta)).astype(np.float32)
    return slot, within, attention_lm.Network(net.theta.astype(np.float64))


def test_probabilities_sum_to_one_and_look_back_only():
    slot, within, net = _network()
    seq = np.array([5, 200, 7, 900])
    total = 0.0
    for s in range(attention_lm.SLOTS):
        x, y, scored = attention_lm.cut_windows(np.append(seq, s))
        ll = net.log_likelihood(x, y, scored)
        total += np.exp(ll[-1])
        assert np.allclose(ll[:-1], net.log_likelihood(*attention_lm.cut_windows(seq)))
    assert abs(total - 1) < 1e-9
    assert np.allclose(np.bincount(slot, weights=10**within)[[0, -1]], 1)


def test_gradient():
    _, _, net = _network()
    x, y, scored = attention_lm.cut_windows(np.random.default_rng(3).integers(0, attention_lm.SLOTS, 60))
    g = net.gradient(x, y, scored)
    loss = lambda t: -attention_lm.Network(t).log_likelihood(x, y, scored).mean()
    for k in np.argsort(-abs(g))[[0, 10, 100, 700, 1500]]:
        step = np.zeros(len(g))
        step[k] = 1e-5
        assert abs(g[k] - (loss(net.theta + step) - loss(net.theta - step)) / 2e-5) < 1e-6


def test_language_features():
    assert language.features(None) is None and language.features("12 ..!") is None
    x = language.features("Été " * 400_000)  # longer than a block
    assert abs(np.linalg.norm(x) - 1) < 1e-5
    assert np.allclose(x, language.features("été " * 400_000))
    model = language.LanguageModel(language.Rows([], []), [])
    assert model.predict("text") == ("und", 0.0)


LONG = "This is the first paragraph of the article and it has enough of the words that are usual in a text to be told apart."
PAGES = [
    (None, ""),
    ("", ""),
    (f"<p>{LONG}", LONG),
    (f"<nav><ul><li><a href=x>Home</a></ul></nav><article><h1>A &amp; B</h1><p>{LONG}<p>Short.</p></article><footer>{LONG}</footer>", f"A & B\n{LONG}\nShort."),
    (f"<header>{LONG}</header><div class='ad'>{LONG}</div><main><p>x<br>y  <b>z</b></p></main><aside>{LONG}</aside><form>{LONG}<input></form>", "x y z"),
    (f"<article><p>{LONG}</p><div class='share'>Share</div><section id=comments><p>{LONG}</p></section></article>", LONG),
    (f"<script>var t='</p>';</script><style>p{{}}</style><!-- <p>no --><article><p>{LONG}</p><script>x", LONG),
    (f"<div>{LONG}</div><div>Short one</div><div><a href=a>{LONG}</a></div><div>Near</div>", f"{LONG}\nShort one"),
    ("plain text &lt;b&gt; 5 &gt; 3", "plain text <b> 5 > 3"),
    (f"<article><p title=\"a>b\">{LONG}</p><p>{'lang ' * 50_000}</p></article>", f"{LONG}\n{('lang ' * 50_000).strip()}"),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_main_text(page, text):
    assert pages.main_text(page) == text


FINNISH = "Kaupunginvaltuusto hyväksyi eilen uuden suunnitelman, jonka mukaan keskustan puistoa laajennetaan ensi vuonna."
CHINESE = "市政府昨天通过了一项新的规划，明年将扩建市中心的公园，并在河边修建新的步行道和自行车道。"
TABLE = "Aaltonen 12 34 56; Bergström 23 45 67; Chandra 34 56 78; Dvořák 45 67 89; Eriksen 56 78 90"
LINKS = "<div><a href=a>Home</a> <a href=b>News</a></div>"
SPARSE_PAGES = [
    (f"{LINKS}<div>{FINNISH}</div><div>Lyhyt</div>{LINKS}", f"{FINNISH}\nLyhyt"),
    (f"{LINKS}<div>{CHINESE}</div>{LINKS}", CHINESE),
    (f"{LINKS}<p>{LONG}</p><div>{TABLE}</div>{LINKS}", f"{LONG}\n{TABLE}"),
    (f"{LINKS}<p>One line of verse</p><p>and one more</p>{LINKS}", "One line of verse\nand one more"),
]


@pytest.mark.parametrize("page,text", SPARSE_PAGES)
def test_main_text_with_few_stop_words(page, text):
    assert pages.main_text(page) == text


OTHER = "Another paragraph that stands beside the article, and it is as long as the article so that it is told apart by its place."
WRAPPED_PAGES = [
    (f"<html><head><title>T</title><meta charset=utf-8><link rel=x><body><p>{LONG}</p>", LONG),
    (f"<head><title>T</title><p>{LONG}</p>", LONG),
    (f"<body class='has-sidebar'><div class='layout has-sidebar'><p>{LONG}</p></div><div class=sidebar>{OTHER}</div>", LONG),
    (f"<div class='content sidebar-right'><article><p>{LONG}</p></article></div>", LONG),
    (f"<form action=x><div><p>{LONG}</p><p>{LONG}</p></div><nav>{OTHER}</nav></form>", f"{LONG}\n{LONG}"),
    (f"<form><nav>{OTHER}</nav><main><p>{LONG}</p><aside>{OTHER}</aside></main></form>", LONG),
    (f"<div class=widget><form><article><h1>A</h1><p>{LONG}</p></article></form></div>", f"A\n{LONG}"),
    (f"<main><p>{LONG}</p></main><form>{OTHER * 9}</form>", LONG),
    (f"<div><p>{LONG}</p></div><aside><article>{OTHER}</article></aside><div class=site-footer>{OTHER}</div>", LONG),
]


@pytest.mark.parametrize("page,text", WRAPPED_PAGES)
def test_main_text_in_wrappers(page, text):
    assert pages.main_text(page) == text


def test_network_stays_finite_whatever_its_weights():
    rng = np.random.default_rng(4)
    net = attention_lm.Network.start(np.full(attention_lm.SLOTS, 1 / attention_lm.SLOTS))
    x, y, scored = attention_lm.cut_windows(rng.integers(0, attention_lm.SLOTS, 200))
    for scale in (1, 30, 1000):
        big = attention_lm.Network((net.theta * scale).astype(np.float32))
        assert np.isfinite(big.log_likelihood(x, y, scored)).all() and (big.log_likelihood(x, y, scored) <= 1e-3).all()
        assert np.isfinite(big.gradient(x, y, scored)).all()
        weights = big.states(x)[4] / big.states(x)[5]
        assert np.allclose(weights.sum(2), 1, atol=1e-3) and (weights[:, np.triu(np.ones((attention_lm.WINDOW,) * 2, bool), 1)] == 0).all()


def test_probabilities_of_the_next_slot_sum_to_one():
    net = attention_lm.Network.start(np.random.default_rng(5).dirichlet(np.ones(attention_lm.SLOTS)))
    net.theta += np.random.default_rng(6).normal(0, 0.5, len(net.theta)).astype(np.float32)
    x, y, scored = attention_lm.cut_windows(np.arange(10))
    x = np.repeat(x, attention_lm.SLOTS, 0)
    y = np.repeat(y, attention_lm.SLOTS, 0)
    at = np.zeros((1, attention_lm.WINDOW), bool)
    at[0, 4] = True
    y[:, 4] = np.arange(attention_lm.SLOTS)
    total = np.exp(net.log_likelihood(x, y, np.repeat(at, len(x), 0)).astype(np.float64)).sum()
    assert abs(total - 1) < 1e-3


@pytest.mark.parametrize("kind,near", [(np.float64, 1e-12), (np.float32, 1e-5)])
def test_network_gives_the_same_with_and_without_shifted_exponentials(monkeypatch, kind, near):
    net = attention_lm.Network(_network()[2].theta.astype(kind))
    x, y, scored = attention_lm.cut_windows(np.random.default_rng(8).integers(0, attention_lm.SLOTS, 300))
    plain = net.log_likelihood(x, y, scored), net.gradient(x, y, scored)
    monkeypatch.setattr(attention_lm, "_LARGE", -1.0)  # every row is shifted
    for a, b in zip(plain, (net.log_likelihood(x, y, scored), net.gradient(x, y, scored)), strict=True):
        assert a.dtype == b.dtype == kind and np.abs(a - b).max() < near * max(1, np.abs(b).max())


def test_words_are_read_once_and_packed():
    import public_tokenizers

    slot, within, net = _network()
    sub = attention_lm.subwords(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    slot, within, _ = attention_lm.slots_of(np.random.default_rng(0).integers(0, 50, sub.size).astype(float))
    scorer = attention_lm.Scorer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, slot, within, net.theta)
    words = [b"don't", b"x" * 700, "café".encode(), b"\xff\xfe", b"don't"]
    ids = [i for w in words for i in sub.of(w)] + [sub.end]
    for _ in range(2):  # with words that are new and with known ones
        slots, inner = scorer.read(words)
        assert slots.tolist() == slot[ids].tolist() and abs(inner - within[ids].sum()) < 1e-9
    assert len(scorer.cache) == 4 and all(isinstance(s, bytes) for s, _ in scorer.cache.values())
    slots, inner = pickle.loads(pickle.dumps(scorer)).read([])
    assert (slots.tolist(), inner) == ([slot[-1]], within[-1])
