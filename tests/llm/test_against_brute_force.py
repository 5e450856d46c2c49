"""Operators that SQL can't express, against plain versions of themselves."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from driftline.llm import common, crf, language_id, lengths, line_dedup, link_graph, matroska, near_dups, packing, pieces, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return common.read(spark, SF, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: (r.text, r.lang) for r in docs.select("doc_id", "text", "lang").collect()}


def js(p, q):
    sp, sq = sum(p), sum(q)
    if not sp or not sq:
        return None
    total = 0.0
    for x, y in zip(p, q):
        x, y = x / sp, y / sq
        m = (x + y) / 2
        total += (x * math.log2(x / m) if x else 0) / 2 + (y * math.log2(y / m) if y else 0) / 2
    return math.sqrt(max(total, 0.0))


def test_quality_histograms_and_distances(docs, texts):
    import unicodedata

    def plain(text, lang):
        chars = [0] * 6
        for c in text:
            k = unicodedata.category(c)
            chars[0 if k == "Ll" else 1 if k == "Lu" else 2 if c in quality.WHITE else 3 if c in quality.MARKS else 4 if k[0] == "N" else 5] += 1
        found = Counter(re.findall(r"[^\W\d_]+", text.lower()))
        axes = [found[w] for w in quality.COMMON_WORDS[lang]]
        return chars, [*axes, sum(found.values()) - sum(axes)]

    rules = quality.QualityRules()
    h = {i: (*plain(t, lang), lang) for i, (t, lang) in texts.items()}
    total = lambda ids, k, lang: [sum(x) for x in zip(*[h[i][k] for i in ids if h[i][2] == lang])]
    first = {lang: total(h, 0, lang) for lang in quality.COMMON_WORDS}
    near = [i for i in h if js(h[i][0], first[h[i][2]]) <= rules.trim_char_distance]
    rows = {r.row.doc_id: r for r in quality.score(docs, carry=("doc_id",)).collect()}
    for i, (c, w, lang) in h.items():
        assert rows[i].n_words == sum(w)
        assert rows[i].char_distance == pytest.approx(js(c, total(near, 0, lang)), abs=1e-9)
        assert rows[i].word_distance == pytest.approx(js(w, total(near, 1, lang)), abs=1e-9)
    assert {r.row.doc_id for r in quality.score(docs).where("keep").collect()} == {i for i, r in rows.items() if r.keep}


def test_quality_follows_labels(spark):
    docs = common.read(spark, "/root/testdata/sf0.01", "documents")
    labels = {r.doc_id: r.quality for r in common.read(spark, "/root/testdata/sf0.01", "labels").collect()}
    rows = {r.row.doc_id: r.keep for r in quality.score(docs, carry=("doc_id",)).collect()}
    good = [rows[i] for i, q in labels.items() if q == 1]
    bad = [rows[i] for i, q in labels.items() if q == 0]
    assert sum(good) / len(good) > 0.98
    assert sum(bad) / len(bad) < 0.4


def test_length_histogram(docs, texts):
    n = {i: len(common.bpe().encode_ordinary(t)) for i, (t, _) in texts.items()}
    sums = lengths.with_suffix_sums(lengths.histogram(docs))
    for r in sums.collect():
        assert r.docs == sum(x == r.n_tokens for x in n.values())
        assert r.docs_at_least == sum(x >= r.n_tokens for x in n.values())
        assert r.tokens_at_least == sum(x for x in n.values() if x >= r.n_tokens)
        assert r.truncated_total == sum(min(x, r.n_tokens) for x in n.values())
    for r in lengths.truncated_totals(sums, [0, 77, 512, 10**9]).collect():
        assert r.kept_tokens == sum(min(x, r.limit) for x in n.values())
        assert r.docs_cut == sum(x > r.limit for x in n.values())
    ordered = sorted(n.values())
    for r in lengths.quantiles(sums, [0.01, 0.5, 0.9, 1.0]).collect():
        assert r.n_tokens == ordered[math.ceil(r.share * len(ordered)) - 1]


def test_pieces_match_the_library(texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=common.PIECE_MODEL)
    e = pieces.encoder()
    rng = random.Random(3)
    parts = ["a", "the", "ing", " ", "  ", "     ", "\n", "\t", "é", "日本", "😀", "12", ".", "▁", "ion", "<s>", "<0x41>", "ß", "A", "ﬁ"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    for t in [*made, *(t for t, _ in texts.values()), "a" * 4000, " " * 1000, "thequickbrown" * 200]:
        assert list(e.encode(t)) == sp.encode(t), t[:80]
        if "▁" not in t:
            assert e.decode(e.encode(t)) == t


def test_streaming_window_is_bounded():
    m = pieces.encoder().m
    online, text, out, held = pieces.Online(m), "donaudampfschifffahrtsgesellschaft日" * 300, [], 0
    for c in text:
        out += online.feed(c)
        held = max(held, len(online.text))
    assert held <= 4 * m.max_piece
    online2 = pieces.Online(m)
    assert out + online.finish() == online2.feed(text) + online2.finish()


def test_crf_held_out_and_windows(texts):
    model = crf.trained()
    finder = crf.Finder(model)
    rows = crf.training_rows(300, seed=99)
    right = total = 0
    for (_, tags), got in zip(rows, finder.decode([tokens for tokens, _ in rows])):
        right += sum(crf.TAGS[a] == b for a, b in zip(got, tags))
        total += len(tags)
    assert right / total > 0.985
    for t, _ in texts.values():  # decoding whole texts gives the same spans as decoding windows
        spans = [m.span() for m in re.finditer(r"[^ \n\t\r]+", t)]
        whole, j = [], 0
        tags = [crf.TAGS[x] for x in finder.decode([[t[a:b] for a, b in spans]])[0]] if spans else []
        while j < len(spans):
            stop = j + 1
            if tags[j][0] == "B":
                while stop < len(spans) and tags[stop] == "I" + tags[j][1:]:
                    stop += 1
                whole.append(finder.trim(t, spans[j][0], spans[stop - 1][1], tags[j][2:]))
            j = stop
        assert whole == finder.spans([t])[0]


def test_viterbi_is_the_best_path():
    import itertools

    rng = np.random.default_rng(0)
    model = crf.trained()
    e = rng.normal(size=(5, 3, len(crf.TAGS))) * 3
    got = crf.viterbi(model, e, np.array([3, 3, 2, 1, 3]))
    for i, n in enumerate([3, 3, 2, 1, 3]):
        score = lambda p: model.first[p[0]] + sum(e[i, j, x] for j, x in enumerate(p)) + sum(model.steps[a, b] for a, b in zip(p, p[1:]))  # noqa: E731, B023
        assert tuple(got[i, :n]) == max(itertools.product(range(len(crf.TAGS)), repeat=n), key=score)


def test_masking(spark):
    t = 'Call +1 (017) 555-7713 or a.b@mail7.example.com, 97.51.17.173; card 4980160719944918. password=b7db7aa4a5fcc78305 token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae" v 4.0. ok'
    out = crf.mask_documents(spark.createDataFrame([(1, t)], "doc_id bigint, text string")).first().text
    assert out == 'Call <PHONE> or <EMAIL>, <IP>; card <CARD>. password=<SECRET> token = "<SECRET>" v 4.0. ok'


def test_line_dedup(docs, texts):
    seen, want = set(), {}
    for i in sorted(texts):
        flags = []
        for line in texts[i][0].split("\n"):
            play = len(line) >= line_dedup.MIN_CHARS and line.strip(" ")
            flags.append(not play or line not in seen)
            if play:
                seen.add(line)
        want[i] = flags
    for r in line_dedup.keep_bitmaps(docs).collect():
        assert line_dedup.kept_flags(r.keep_bitmap).tolist() == want[r.doc_id]
        assert r.n_kept == sum(want[r.doc_id])
    left = {r.doc_id: r for r in line_dedup.drop_repeated_lines(docs).collect()}
    for i, flags in want.items():
        new = "\n".join(x for x, k in zip(texts[i][0].split("\n"), flags) if k)
        assert (i in left) == (new.strip(" ") != "")
        assert i not in left or (left[i].text, left[i].n_chars) == (new, len(new))


def _grams(text, n=3):
    words = re.findall(rb"[0-9a-z\x80-\xff]+", bytes(text, "utf-8").lower())
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def _linked(sets: dict, threshold: float = 0.5):
    """Links and classes by comparing all pairs that share an n-gram."""
    inverted: dict = {}
    for i, x in sets.items():
        for g in x:
            inverted.setdefault(g, []).append(i)
    shared = Counter((a, b) for ids in inverted.values() for x, a in enumerate(ids) for b in ids[x + 1 :])
    links, parent = Counter(), {i: i for i in sets}
    find = lambda x: x if parent[x] == x else find(parent[x])
    for (a, b), n in shared.items():
        if n / (len(sets[a]) + len(sets[b]) - n) >= threshold:
            links[a] += 1
            links[b] += 1
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return links, {i: find(i) for i in sets}


def test_near_dups(spark):
    docs = common.read(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    sets = {r.doc_id: _grams(r.text) for r in docs.collect()}
    links, least = _linked(sets)
    rows = near_dups.classes(docs).collect()
    assert sorted(r.doc_id for r in rows) == sorted(sets)
    assert all(r.links <= links[r.doc_id] for r in rows)
    assert sum(r.links for r in rows) >= 0.95 * sum(links.values())
    assert sum(r.class_id == least[r.doc_id] for r in rows) >= 0.99 * len(rows)
    kept = {r.doc_id for r in near_dups.one_of_each_group(docs).collect()}
    assert kept == {r.doc_id for r in rows if r.class_id == r.doc_id}


def _variants(rng, words: int, edits: int, n: int, vocabulary: int = 4000) -> list[str]:
    """n texts, each an original with some words changed."""
    first = rng.integers(0, vocabulary, words)
    out = []
    for _ in range(n):
        x = first.copy()
        x[rng.choice(words, edits, replace=False)] = rng.integers(0, vocabulary, edits)
        out.append(" ".join(f"w{i}" for i in x))
    return out


@pytest.mark.parametrize("edits", [4, 12])  # 12: only few are in the core
def test_near_dups_in_blocks(spark, edits):
    rng = np.random.default_rng(edits)
    texts = [t for _ in range(2) for t in _variants(rng, 120, edits, 40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *texts[::7]])], "doc_id bigint, text string").repartition(4)
    sets = {r.doc_id: _grams(r.text) for r in docs.collect()}
    links, least = _linked(sets)
    whole, blocks = ({r.doc_id: (r.class_id, r.links) for r in near_dups.classes(docs, near_dups.Settings(task_grams=n)).collect()} for n in (10**6, 700))
    assert whole == blocks  # seven blocks a group
    assert {i: c for i, (c, _) in blocks.items()} == least
    assert sum(n for _, n in blocks.values()) >= (0.95 if edits > 4 else 1) * sum(links.values()) and all(n <= links[i] for i, (_, n) in blocks.items())


def test_prefixes_are_shortened_until_the_recall(spark):
    s, rng = near_dups.Settings(), np.random.default_rng(3)
    depth = {}
    for edits in (1, 22):
        docs = spark.createDataFrame([(i, t) for i, t in enumerate(t for _ in range(60) for t in _variants(rng, 150, edits, 2))], "doc_id bigint, text string")
        texts = near_dups.distinct_texts(near_dups.signatures(docs, s))
        depth[edits] = near_dups.adaptive_depth(near_dups.estimated(near_dups.edges(texts, s), texts, s), s)
    assert s.stop_depth() == 4 and depth == {1: 6, 22: 4}


def test_node_edges():
    rng = np.random.default_rng(2)
    s = near_dups.Settings(trees=3, depth=3, recall=0.6, window=3)
    floor = s.stop_depth()
    assert floor < 3
    rows = sorted((int(t) << 24 | int(a) << 16 | int(b) << 8 | int(c), i, 0) for i in range(90) for t, (a, b, c) in enumerate(rng.integers(0, 4, (3, 3))))
    key, s1, s2 = (np.array(x, np.int64) for x in zip(*rows))
    found = near_dups.node_edges(key, s1, s2, s, (False, False))
    got = {(int(a), int(b)): (int(n), bool(c)) for n, c, a, _, b, _ in zip(*found)}
    shared = lambda x, y: next(d for d in range(3, -1, -1) if x >> 8 * (3 - d) == y >> 8 * (3 - d))
    nodes: dict = {}
    for k, i, _ in rows:
        nodes.setdefault(k >> 8 * (3 - floor), []).append((k, i))
    want: dict = {}
    for members in nodes.values():
        small = len(members) <= s.window + 1
        for x, (k, i) in enumerate(members):
            for k2, j in members[x + 1 :] if small else members[x + 1 : x + 2]:
                want.setdefault((i, j), set()).add((shared(k, k2), not small))
    assert set(got) == set(want) and all(got[p] in want[p] for p in got)


def test_edges_join_what_partitions_cut(spark, monkeypatch):
    """All texts in one node, in many partitions and pieces: they hold together."""
    monkeypatch.setattr(near_dups, "HELD", 5)
    s = near_dups.Settings()
    sig = bytes(240)
    texts = spark.createDataFrame([(i, i, sig, 1, i, 1) for i in range(200)], "s1 bigint, s2 bigint, signature binary, n_grams bigint, rep bigint, copies bigint").repartition(4)
    comp = near_dups.components(near_dups.edges(texts, s)).collect()
    assert len(comp) == 200 and {r.c1 for r in comp} == {0}


def test_links_in_block():
    rng = np.random.default_rng(0)
    base = [rng.integers(0, 400, 60) for _ in range(3)]
    sets = [np.unique(np.where(rng.random(60) < 0.15, rng.integers(0, 400, 60), base[i % 3])) for i in range(70)]
    copies = rng.integers(1, 4, 70)
    j = np.array([[len(np.intersect1d(a, b)) / len(np.union1d(a, b)) for b in sets] for a in sets])
    linked = (j >= 0.5) & ~np.eye(70, dtype=bool)
    for block in (16, 512):
        got = np.zeros((70, 70))
        for i, k, m in near_dups.similarity_blocks(sets, 30, apart=True, block=block):
            got[i : i + len(m), k : k + m.shape[1]] = m
        assert np.allclose(got[:30, 30:], j[:30, 30:]) and not got[30:].any()
    links, core, label = near_dups.links_in_block(sets, copies, np.ones(70, bool), 5, 0.5)
    assert (core == (j[5] >= 0.75)).all() and (links == linked @ copies).all()
    assert len(set(label)) == 3 and all(len(set(label[k::3])) == 1 for k in range(3))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 60), 0, rng.randint(0, 60), 0) for _ in range(35)] + [(i, 0, i + 1, 0) for i in range(100, 140)]
    got = {r.s1: r.c1 for r in near_dups.components(spark.createDataFrame(edges, "a1 bigint, a2 bigint, b1 bigint, b2 bigint")).collect()}
    parent: dict = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, _, b, _ in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    named = {x for a, _, b, _ in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in named}


def test_language_filters(spark):
    docs = common.read(spark, "/root/testdata/sf0.01", "documents")
    model = language_id.train(docs)
    labels = {r.doc_id: (r.lang, r.n_chars) for r in docs.collect()}
    rows = language_id.identify(docs, model).collect()
    long = [(r.language, labels[r.doc_id][0]) for r in rows if labels[r.doc_id][1] >= 100]
    assert sum(a == b for a, b in long) / len(long) > 0.98
    sets = {lang: set() for lang in model.languages}
    sample = rows[:20]
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in sample:  # counts by plain loops over the table
        data = bytes(language_id._LOWER[np.frombuffer(text[r.doc_id].encode(), np.uint8)])
        n, hits = 0, [0] * len(sets)
        for i in range(len(data) - language_id.GRAM + 1):
            x = np.frombuffer(data[i : i + language_id.GRAM].ljust(8, b"\0"), np.uint64)
            h = int(common.mix64(x)[0])
            mask = 255
            for k in range(3):
                mask &= int(model.table[(h >> (21 * k)) & (model.settings.rows - 1), 0])
            n += 1
            for k in range(len(sets)):
                hits[k] += mask >> k & 1
        assert (r.n_grams, list(r.hits)) == (n, hits)


def test_vector_bins():
    rng = np.random.default_rng(2)
    limits = np.array([100, 5, 60])
    sizes = np.stack([rng.integers(1, 60, 200), np.ones(200, np.int64), rng.integers(0, 40, 200)], axis=1)
    bins = packing.dot_product_bins(sizes, limits)
    assert (bins >= 0).all()
    for b in range(bins.max() + 1):
        assert (sizes[bins == b].sum(axis=0) <= limits).all()
    lower = max(math.ceil(x) for x in sizes.sum(axis=0) / limits)
    assert bins.max() + 1 <= 1.15 * lower
    # a plain version that follows the rule literally
    rel, left, plain, b = sizes / limits, set(range(200)), np.full(200, -1), -1
    rank = sorted(range(200), key=lambda i: (-rel[i].sum(), i))
    while left:
        b, room = b + 1, limits.copy()
        while ok := [i for i in rank if i in left and (sizes[i] <= room).all()]:
            best = max(ok, key=lambda i: (rel[i] @ (room / limits)))
            plain[best] = b
            room = room - sizes[best]
            left.remove(best)
    assert (plain == bins).all()


def test_split_example():
    limits = packing.Limits(tokens=10, segments=4, loss_tokens=6)
    got = packing.split_example([(7, False), (9, True), (3, False)], limits)
    assert sum(n for _, n, _ in got) == 19 and sum(x for *_, x in got) == 9
    assert all(n <= 10 and x <= 6 for _, n, x in got)
    assert [s for s, *_ in got] == [sum(n for _, n, _ in got[:i]) for i in range(len(got))]


def test_conversations_are_packed_whole(spark):
    limits = packing.Limits()
    turns = common.read(spark, SF, "conversations")
    want: Counter = Counter()
    loss: Counter = Counter()
    for r in turns.collect():
        n = len(common.bpe().encode_ordinary(r.text))
        want[r.conv_id] += n
        loss[r.conv_id] += n * (r.role == "assistant")
    rows = packing.pack(packing.conversation_pieces(turns, limits), limits, shard_size=16).collect()
    got: Counter = Counter()
    got_loss: Counter = Counter()
    bins: dict = {}
    for r in rows:
        got[r.doc_id] += r.tokens
        got_loss[r.doc_id] += r.loss_tokens
        b = bins.setdefault((r.shard, r.bin), [0, 0, 0])
        for k, x in enumerate((r.tokens, r.segments, r.loss_tokens)):
            b[k] += x
    assert got == want and +got_loss == +loss
    assert all(a <= limits.tokens and s <= limits.segments and x <= limits.loss_tokens for a, s, x in bins.values())


def test_link_graph_ranks(spark):
    pages = [(i, f"http://{h}/", "".join(f"<a href='http://{x}/'>" for x in to)) for i, (h, to) in enumerate([("good.example.org", ["a.com", "b.com"]), ("a.com", ["b.com"]), ("b.com", ["a.com", "bad.net"]), ("spam.net", ["bad.net"]), ("lone.net", [])])]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    s = link_graph.Settings(trusted=("good.example.org",), blocked=("bad.net",), tolerance=0.05)
    edges = {(r.src, r.dst): r.weight for r in link_graph.host_edges(link_graph.page_links(df)).collect()}
    hosts = sorted({x for e in edges for x in e} | {"lone.net"})
    rows = {r.host: r for r in link_graph.host_decisions(link_graph.page_links(df), s).collect()}
    assert set(rows) == set(hosts)
    for name, seeds, flip in (("trust", s.trusted, False), ("distrust", s.blocked, True)):
        g = {((b, a) if flip else (a, b)): w for (a, b), w in edges.items()}
        out = {h: sum(w for (a, _), w in g.items() if a == h) for h in hosts}
        seed = {h: (h in seeds) / len(seeds) for h in hosts}
        mass = {h: (1 - s.damping) * seed[h] for h in hosts}
        total = dict(mass)
        for _ in range(s.rounds()):  # what is passed on, added up
            mass = {h: s.damping * sum(mass[a] * w / out[a] for (a, b), w in g.items() if b == h) for h in hosts}
            total = {h: total[h] + mass[h] for h in hosts}
        assert sum(mass.values()) * s.damping / (1 - s.damping) <= s.tolerance
        rank = dict(seed)
        for _ in range(400):  # the rank itself
            stuck = sum(rank[h] for h in hosts if not out[h])
            rank = {h: (1 - s.damping + s.damping * stuck) * seed[h] + s.damping * sum(rank[a] * w / out[a] for (a, b), w in g.items() if b == h) for h in hosts}
        for h in hosts:
            assert getattr(rows[h], name) == pytest.approx(total[h] / sum(total.values()), abs=1e-9)
            assert getattr(rows[h], name) == pytest.approx(rank[h], abs=s.tolerance)
    assert not rows["spam.net"].keep and rows["good.example.org"].keep and rows["lone.net"].keep


def test_link_graph_says_when_no_seed_matches(spark):
    import warnings

    link_of = lambda *hosts: link_graph.page_links(spark.createDataFrame([(k, f"http://{h}/", "") for k, h in enumerate(hosts)], "page_id bigint, url string, html string"))
    with pytest.warns(UserWarning, match="no host matches the seeds of distrust"):
        link_graph.host_decisions(link_of("a.example.org", "b.example.com"))
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        link_graph.host_decisions(link_of("a.example.org", "b.example.net"))


def test_link_graph_rounds_have_small_plans(spark, monkeypatch):
    key, plans, cut = "spark.sql.adaptive.enabled", [], link_graph.cut

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    hosts = spark.createDataFrame([(side, h, float(h == "a")) for side in ("trust", "distrust") for h in "abc"], "side string, host string, seed double")
    edges = spark.createDataFrame([(side, x, y, 1.0) for side in ("trust", "distrust") for x, y in ("ab", "bc", "ca")], "side string, src string, dst string, share double")
    s = link_graph.Settings(tolerance=0.3)
    before = spark.conf.get(key)
    monkeypatch.setattr(link_graph, "cut", seen)
    ranks = {(r.side, r.host): r["rank"] for r in link_graph.personalised_ranks(hosts, edges, s).collect()}
    assert spark.conf.get(key) == before
    rounds = [p for p in plans if "ShuffledHashJoin" in p]
    assert sum(p.count("ShuffledHashJoin") for p in rounds) == s.rounds() and len(rounds) > 1
    assert not any(x in p for p in rounds for x in ("AdaptiveSparkPlan", "BroadcastExchange", "SortMergeJoin"))
    # a shuffle a round, and one to put the first state in place
    assert [p.count("Exchange hashpartitioning") for p in rounds] == [p.count("ShuffledHashJoin") + (k == 0) for k, p in enumerate(rounds)]
    mass = [(1 - s.damping) * s.damping**k for k in range(s.rounds() + 1)]  # goes round the ring
    for k, h in enumerate("abc"):
        assert ranks["trust", h] == ranks["distrust", h] == pytest.approx(sum(mass[k::3]) / sum(mass), abs=1e-12)


@pytest.mark.parametrize("lacing", [0, 1, 2, 3])
@pytest.mark.parametrize("unknown", [False, True])
def test_matroska_round_trip(lacing, unknown):
    rng = random.Random(lacing)
    parts = [bytes(rng.randrange(256) for _ in range(40 if lacing == 2 else rng.choice([0, 3, 254, 255, 600]))) for _ in range(1 if lacing == 0 else 6)]
    clusters = [
        (t, [matroska.element(matroska.SIMPLE, matroska.block(1, 7, parts, lacing, key=t == 0)), matroska.element(matroska.GROUP, matroska.element(matroska.BLOCK, matroska.block(300, -3, [b"sub"], simple=False)) + matroska.number(matroska.DURATION, 40) + (matroska.number(matroska.REFERENCE, 1) if t else b""))])
        for t in (0, 5000)
    ]
    blob = matroska.container([(1, 2, "A_X", 20_000_000), (300, 17, "S_TEXT/UTF8", None)], clusters, unknown, scale=500_000)
    m = matroska.parse(blob)
    assert m.error is None and m.scale == 500_000
    assert [blob[p.start : p.end] for p in m.packets] == [*parts, b"sub"] * 2
    assert [p.time for p in m.packets if p.track == 300] == [-3, 4997]
    assert [p.key for p in m.packets if p.track == 300] == [True, False]
    assert {p.lacing for p in m.packets if p.track == 1} == {matroska.LACINGS[lacing]}
    assert {m.segment + pos for _, _, pos in m.cues} == {p.cluster for p in m.packets}
    for cut in range(0, len(blob), 37):
        part = matroska.parse(blob[:cut])
        assert all(p.end <= cut for p in part.packets)
        assert [(p.start, p.end) for p in part.packets] == [(p.start, p.end) for p in m.packets[: len(part.packets)]]
