"""The operators against brute force, on small tables with nulls, empty and repeated rows."""

import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillmark.llm import chat, components, decontaminate, htmltext, mixing, neardup, quality, secrets, sharding, substrings, textkit

SCHEMA = "doc_id long, text string, lang string, source string, size string"


def prose(rng, n, words=300):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, "clash") for i, t, lang, src in rows], SCHEMA).repartition(3)


def odd_rows():
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randrange(0, 200)), rng.choice(["en", "de", None]), rng.choice(["a", "b", None])) for i in range(30)]
    return rows + [(40, None, None, None), (None, "x y z " * 40, "en", "a"), (41, "", "en", "c"), (42, " \n\t ", "en", "b"), (3, rows[3][1], rows[3][2], "a"), (43, rows[3][1], "en", "a")]


def test_mixing_targets_match_iterated_resharing(spark):
    rng = random.Random(1)
    for _ in range(3):
        sizes = {f"s{i:02d}": rng.choice([0, 1, 10, 1000, 5000]) for i in range(8)}
        got = {r.source: r for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(sizes))}
        total, capped = sum(sizes.values()), {}
        while True:
            free = [s for s in sizes if s not in capped]
            level = (total - sum(capped.values())) / sum(weight[s] for s in free) if free else 0
            over = [s for s in free if level * weight[s] > 3 * sizes[s]]
            if not over:
                break
            capped |= {s: 3 * sizes[s] for s in over}
        for s in sizes:
            assert abs(got[s].target - capped.get(s, level * weight[s])) < 1e-6 * max(1, total) and 0 <= got[s].rate <= 3


def test_mixing_rows(spark):
    df = table(spark, odd_rows())
    out = mixing.report(df).collect()
    assert len(out) == 36 and all(0 <= r.taken <= 3 * r.size for r in out)
    assert mixing.mix(df).count() == sum(r.copies for r in out) and mixing.mix(df).columns == df.columns
    assert mixing.report(df.limit(0)).count() == 0


def best_fit_by_hand(sizes, capacity):
    """Group by group, the tightest bin found by looking at all; the groups' bins in order of size."""
    left, out = [], []
    for size in sorted(sizes, reverse=True):
        fit = min((x for x in enumerate(left) if x[1] >= size), key=lambda x: (x[1], x[0]), default=None)
        if fit is None:
            left.append(max(capacity, size) - size)
            out.append((size, len(left) - 1))
        else:
            left[fit[0]] -= size
            out.append((size, fit[0]))
    return sorted(out), len(left)


def test_best_fit_on_sizes_is_that_on_groups():
    rng = random.Random(2)
    for k in range(60):
        sizes = [rng.choice([rng.randrange(1, 100), 7, 13, 50]) for _ in range(rng.randrange(200))]
        capacity = rng.choice([60, 100, 1000])
        steps, n = sharding.best_fit_decreasing(Counter(sizes), capacity)
        got = sorted((size, b + (i - first) // each) for size, first, end, b, each in steps for i in range(first, end))
        assert (got, n) == best_fit_by_hand(sizes, capacity), k
    for _ in range(20):
        sizes = [rng.randrange(1, 100) for _ in range(500)]
        loads = Counter()
        for size, first, end, b, each in sharding.fixed_bins(Counter(sizes), 8):
            for i in range(first, end):
                loads[b + (i - first) // each] += size
        assert len(loads) <= 8 and sum(loads.values()) == sum(sizes) and max(loads.values()) - min(loads.values()) <= 60


def test_rounded_sizes(spark):
    sizes = [1, 2, 3, 4095, 4096, 4097, 5000, 1 << 20, (1 << 20) + 1, 123_456_789, (1 << 40) + 12_345]
    got = spark.createDataFrame([(x,) for x in sizes], "x long").select("x", sharding.rounded(F.col("x")).alias("up"), sharding.rounded(F.col("x"), 5000).alias("within")).collect()
    assert all(r.x <= r.up <= r.x * (1 + 2**-11) and (r.up == r.x or r.x > 4096) and (r.within <= 5000) == (r.x <= 5000) for r in got)


def test_shards_and_slots(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART_ROWS", 5)
    every = odd_rows() + [(None, f"t{i % 5}", "en", "a") for i in range(40)] + [(7, "same", "en", "a")] * 30
    rows = sharding.report(table(spark, every)).collect()
    assert sorted(r.size for r in rows) == sorted(len((t or "").encode()) + 1 for _, t, _, _ in every)
    for s in {r.shard for r in rows}:
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own))) and 0 <= s < 8
    assert len({r.shard for r in rows if r.doc_id == 7 and r.size == 5}) == 1 and len({r.shard for r in rows if r.size == 3}) <= 5
    assert sharding.report(table(spark, odd_rows()).limit(0)).count() == 0


def test_fixed_capacity_is_kept(spark):
    rng = random.Random(14)
    for low, high, capacity in ((20, 60, 200), (8, 14, 40)):
        sizes = {i: rng.randrange(low, high) for i in range(3000)}
        rows = [(i, f"{i:05d}" + "x" * (n - 6), "en", "a") for i, n in sizes.items()]
        loads = Counter()
        for r in sharding.assign(table(spark, rows), capacity=capacity).collect():
            loads[r.shard] += r.size
        assert sum(loads.values()) == sum(sizes.values()) and max(loads.values()) <= capacity
        assert len(loads) == best_fit_by_hand(list(sizes.values()), capacity)[1]
    huge = [(1, "y" * 500, "en", "a"), (2, "z", "en", "a")]
    assert len({r.shard for r in sharding.assign(table(spark, huge), capacity=100).collect()}) == 2


def test_chat_round_trip(spark):
    rng = random.Random(51)
    bits = ["<|", "|>", "\\", "\\\\", "<\\|", "\n", "im_start", "<|im_start|>", "<|im_end|>\n", "assistant", "é", "日", " ", "", "a"]
    rows = [(1, 0, "user", "a <| \\ <\\| b"), (1, 1, "assistant", "x\n<|im_end|>"), (1, 2, "user", None), (2, None, None, "q"), (2, 1, "as\nst", ""), (None, 0, "assistant", "y"), (None, 0, "assistant", "y"), (None, 0, "assistant", "w")]
    rows += [(c, rng.choice([None, 0, 1, 2, 3]), rng.choice(["user", "assistant", "assistant", "sys\ntem", None]), "".join(rng.choice(bits) for _ in range(rng.randrange(8)))) for c in range(10, 60) for _ in range(rng.randrange(1, 9))]
    rows += [(99, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(300)]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "conv_id long, turn long, role string, text string, example string").repartition(3)

    def turns_of(conv):
        if conv == -1:
            return [(a, "<|im_end|><|im_start|>assistant ok") for a in ("user", "assistant")]
        return [(a, t) for _, a, t in sorted(((-1 if n is None else n, a or "", t or "") for c, n, a, t in rows if c == conv), key=lambda x: (x[0], x[1].encode(), x[2].encode()))]

    def formatted(role, text):
        def escape(x):
            return x.replace("\\", "\\\\").replace("<|", "<\\|")

        return "<|im_start|>" + escape(role).replace("\n", "<|nl|>") + "\n", escape(text), "<|im_end|>\n"

    want, chars = {}, Counter()
    for conv in {c for c, *_ in rows} | {-1}:
        own = turns_of(conv)
        ends = [k for k, (a, _) in enumerate(own) if a == "assistant" or k == len(own) - 1]
        for example, k in enumerate(ends):
            before, (head, body, tail) = "".join("".join(formatted(*t)) for t in own[:k]), formatted(*own[k])
            text = before + head + body + tail
            mask = (len(before + head), len(before + head + body)) if own[k][0] == "assistant" else (len(text), len(text))
            want[conv, example] = (text, *mask)
            chars[conv] += len(text)
    trap = chat.with_trap(df)
    assert {(r.conv_id, r.example): (r.text, r.loss_start, r.loss_end) for r in chat.examples(trap).collect()} == want
    got = chat.report(trap).collect()
    assert len(got) == len({c for c, _ in want})
    for r in got:
        own = turns_of(r.conv_id)
        assert r.n_turns == len(own) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in own).encode()).hexdigest()
        loss = "".join(t for a, t in own if a == "assistant")
        assert (r.loss_chars, r.loss_sha256, r.formatted_chars) == (len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars[r.conv_id])
    assert chat.report(df.limit(0)).count() == 0


def test_html():
    page = "<html><title>t</title><body><nav><a href=x>menu</a></nav><div class='ad'>Buy this, now. Really.</div><article><h1>Head &amp; more</h1><p>One  long\nparagraph, with <b>bold</b> text. And more.<p>Two.</p></article><div id='comments'><p>I, for one, like it. Very much so.</p></div><footer>end, of it.</footer><script>var a='<p>no</p>'"
    assert htmltext.main_text(page) == "Head & more\nOne long paragraph, with bold text. And more.\nTwo."
    assert htmltext.main_text(None) == htmltext.main_text("") == htmltext.main_text("<p>") == ""


def test_html_keeps_whole_articles():
    long = "A long, plain sentence of the article. " * 20
    menu = "<nav><a href=x>menu</a></nav>"
    parts = {
        "sections": (f"<h1>Head</h1><section><p>{long}</p></section><section><p>Short, last part.</p></section>", ["Head", long.strip(), "Short, last part."]),
        "list": (f"<p>Before.</p><ul><li>{long}</li><li>Two.</li></ul><p>After.</p>", ["Before.", long.strip(), "Two.", "After."]),
        "table": (f"<p>Before.</p><table><tr><td>{long}</td><td>Cell.</td></tr></table><p>After.</p>", ["Before.", long.strip(), "Cell.", "After."]),
        "links": (f"<h2><a href=x>Linked head</a></h2><p>{long}</p><p><a href=x>See this.</a></p><ol><li><a href=x>First source</a></li><li><a href=y>Second source</a></li></ol>", ["Linked head", long.strip(), "See this.", "First source", "Second source"]),
    }
    for name, (inner, want) in parts.items():
        for open_, close in (("<article>", "</article>"), ("<div class=story>", "</div>")):
            assert htmltext.main_text(f"<body>{menu}{open_}{inner}{close}<footer>end</footer></body>").split("\n") == want, (name, open_)
    loose = f"<body><div><div><a href=x>Home</a></div><div><a href=y>News</a></div></div><h1><a href=z>Head</a></h1><div><p>{long}</p></div></body>"
    assert htmltext.main_text(loose).split("\n") == ["Head", long.strip()]


def test_tiles_find_reordered_passages():
    rng = random.Random(7)
    item = prose(rng, 40, 10_000).split()
    doc = " ".join(prose(rng, 30, 10_000).split() + item[20:] + ["between"] + item[:20])
    laid = decontaminate.tiles(decontaminate.tokens(doc), decontaminate.tokens(" ".join(item)))
    assert sorted(x[1:] for x in laid) == [(0, 20), (20, 20)]


def test_decontaminate(spark):
    rng = random.Random(8)
    items = [(i, prose(rng, 30, 10_000)) for i in range(5)] + [(9, None), (None, "a b")]
    rows = [(1, prose(rng, 50) + " " + items[2][1].upper() + "!", "en", "a"), (2, prose(rng, 60), "en", "a"), (3, None, None, None)]
    df, b = table(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.report(df, b).collect()] == [(1, 2)]
    assert {r.doc_id for r in decontaminate.drop(df, b).collect()} == {2, 3} and decontaminate.report(df, b.limit(0)).count() == 0


def test_substrings_match_brute_force(spark):
    rng = random.Random(9)
    shared = prose(rng, 70, 10_000)
    rows = [(i, " ".join([prose(rng, rng.randrange(80), 10_000), shared if i % 3 else "", prose(rng, 30, 10_000)]), "en", "a") for i in range(20)] + odd_rows()
    words = [(i, (t or "").split()) for i, t, _, _ in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for k in range(len(w) - 49):
                key = tuple(w[k : k + 50])
                first[key] = min(first.get(key, i), i)
    want = []
    for i, w in words:
        gone = {j for k in range(len(w) - 49) if i is not None and first[tuple(w[k : k + 50])] < i for j in range(k, k + 50)}
        want.append((i if i is not None else -1, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    got = [(r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.report(table(spark, rows)).collect()]
    assert sorted(got) == sorted(want)


def test_near_duplicates(spark):
    rng = random.Random(10)
    base = prose(rng, 120, 10_000).split()
    rows = [(100 + i, " ".join(base[:k] + ["edit"] + base[k + 1 :]), "en", "a") for i, k in enumerate((10, 50, 90, 115))] + [(99, " ".join(base), "en", "a"), *odd_rows()]
    got = {r.doc_id: r.class_id for r in neardup.report(table(spark, rows)).collect()}
    assert {got[k] for k in (99, 100, 101, 102, 103)} == {99} and got[43] == got[3] == 3
    assert all(got[i] == i for i in (0, 1, 2, 40, 41, 42)) and neardup.drop(table(spark, rows)).count() == len(rows) - 4 - 2


def test_near_duplicates_count_every_link_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 40)
    rng = random.Random(12)
    base = prose(rng, 150, 10_000).split()
    family = []
    for _ in range(150):
        words = list(base)
        for k in rng.sample(range(150), rng.randrange(1, 6)):
            words[k] = f"e{rng.randrange(10_000)}"
        family.append(" ".join(words))
    rows = [(i, t, "en", "a") for i, t in enumerate(family)] + [(1000 + i, prose(rng, 60, 10_000), "en", "a") for i in range(60)]
    df = table(spark, rows)
    sketch = neardup.document_frequencies(df)
    sets = [neardup.weighted(t, sketch) for t in family]
    bands = [neardup.signature(*x).reshape(-1, neardup.ROWS) for x in sets]
    want = Counter()
    for i in range(len(family)):
        for j in range(i):
            if (bands[i] == bands[j]).all(axis=1).any() and neardup.similarity(sets[i], sets[j]) >= neardup.SIMILARITY:
                want.update((i, j))
    got = {r.doc_id: r.n_links for r in neardup.report(df).collect()}
    assert max(want.values()) > 2 * neardup.SMALL and {i: n for i, n in got.items() if n} == want
    texts = family[:20] + ["a b " * 30, "a b " * 50, "x"]
    sets = [neardup.weighted(t, sketch) for t in texts]
    assert np.allclose(neardup.similarities(texts[:9], texts, sketch), [[neardup.similarity(x, y) for y in sets] for x in sets[:9]])
    assert np.allclose(neardup.similarities(texts[20:], texts[20:], sketch), [[neardup.similarity(x, y) for y in sets[20:]] for x in sets[20:]])


def test_near_duplicates_of_a_hot_text_against_all_pairs(spark):
    """240 edits of one text that a third of all rows hold as it is: every link of all pairs, but for the misses of the bands."""
    rng = random.Random(16)
    base = prose(rng, 150, 10_000).split()
    texts = [" ".join(base)]
    for _ in range(240):
        words = list(base)
        for k in rng.sample(range(150), rng.randrange(1, 5)):
            words[k] = f"e{rng.randrange(10_000)}"
        texts.append(" ".join(words))
    texts += [prose(rng, 150, 10_000) for _ in range(150)]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)] + [(1000 + i, texts[0], "en", "a") for i in range(200)] + [(5, texts[5], "en", "a")] * 3
    df = table(spark, rows)
    sketch = neardup.document_frequencies(df)
    sets = [neardup.weighted(t, sketch) for t in texts]
    for plain in (True, False):
        want, parent = Counter(), list(range(len(texts)))

        def find(v, parent=parent):
            while parent[v] != v:
                v = parent[v]
            return v

        for i in range(len(texts)):
            for j in range(i):
                if neardup.similarity(sets[i], sets[j], plain) >= neardup.SIMILARITY:
                    want.update((i, j))
                    parent[max(find(i), find(j))] = min(find(i), find(j))
        got = {r.doc_id: r for r in neardup.report(df, plain).collect()}
        assert {i: got[i].class_id for i in range(len(texts))} == {i: find(i) for i in range(len(texts))} and got[1000].class_id == 0
        assert all(got[i].n_links <= want[i] for i in range(len(texts))) and sum(got[i].n_links for i in range(len(texts))) >= 0.999 * sum(want.values()) > 0
    assert neardup.report(df.limit(0)).count() == 0 and neardup.drop(df.limit(0)).count() == 0


def test_vertices_sort_like_doc_ids(spark):
    ids = [None, -(1 << 63), -5, -1, 0, 1, 7, (1 << 63) - 1]
    df = spark.createDataFrame([(i, bytes(16)) for i in ids], "i long, d binary").withColumn("v", neardup.vertex(F.col("i"), F.col("d")))
    got = [(r.i, r.back) for r in df.select("i", neardup.vertex_id(F.col("v")).alias("back"), "v").orderBy("v").collect()]
    assert got == [(i, i) for i in [*ids[1:], None]]


def test_signature_agrees_with_similarity():
    rng = np.random.default_rng(3)
    x = np.unique(rng.integers(0, 1 << 63, 900, dtype=np.uint64))
    w = rng.uniform(0.5, 6, x.size)
    a, b, k = (x[:780], w[:780]), (x[120:], w[120:]), neardup.BANDS * neardup.ROWS
    hits = neardup.signature(*a) == neardup.signature(*b)
    assert abs(hits[:k].mean() - w[120:780].sum() / w.sum()) < 0.2 and abs(hits[k:].mean() - 660 / 900) < 0.2


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)]
    parent = {}

    def find(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.v: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {v: find(v) for a, b in pairs if a != b for v in (a, b)}


def test_secret_network_on_held_out_findings():
    net = secrets.trained()
    x, y, kinds = secrets.labelled_findings(2400, seed=99)
    accepted = net.probability(x) >= net.thresholds[kinds]
    for k in range(4):
        assert accepted[(y > 0) & (kinds == k)].mean() > 0.88 and accepted[(y < 1) & (kinds == k)].mean() < 0.1, secrets.KINDS[k]
    assert len(set(net.thresholds.tolist())) == 4


def test_secret_network_finds_what_patterns_miss_and_rejects_look_alikes():
    net, key, other = secrets.trained(), "Zk3fQ9xL2mVb7TqR8wYp1NcD", "9f8Qw2LmNx7ZtY4rKp1VbC6d"

    def more(text):
        base, found, _ = secrets.scan([text], net)[0]
        return [text[s:e] for s, _, e in base], [text[s:e] for s, _, e in found]

    assert more(f"export KEY={key}\n")[1] and more(f"Authorization: Bearer ghp_{key}aB3dE5fG7hI9\n")[1]
    for run in (f"see /a/{'path/' * 20}{key}{'/end' * 20} x", f"x https://h/{'abc/' * 20}{other}/{'de/' * 40}{key}/{'fg/' * 30}"):
        found = more(run)[1]  # in the middle of long runs, both of two, and no more of the path than the key
        assert [x for x in (other, key) if x in run] == [x for x in (other, key) if any(x in y and len(y) < 60 for y in found)], found
    base, found = more(f"token={'aZ1' * 8}/{'dir/' * 5}{key}")  # one match of a pattern leaves nothing of its run
    assert len(base) == 1 and not found
    base, found = more(f"{key}{'.' * 70}{'0a' * 12}.{other}")  # what is left around a match is scored
    assert base == ["0a" * 12] and any(other in x for x in found)
    for dull in ("Donaudampfschifffahrtsgesellschaft", "mail3.example.com", "/usr/share/some/words/of/path", "4384629405288451", "=" * 60, "a_function_name_of_words", "the-slug-of-some-words"):
        assert more(f"it is {dull} here") == ([], [])
    assert [secrets.scan([x], net)[0][2] for x in ("commit 9fceb02d0ae598e95dc970b74767f19372d61af8\n", "auth = 9fceb02d0ae598e95dc970b74767f19372d61af8\n")] == [1, 0]


def base_by_hand(text):
    """The base spans by trying every place in turn."""
    words, value = ("password", "passwd", "secret", "token", "apikey", "api_key"), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"

    def assign(i):
        for w in sorted(words, key=len):
            k = i + len(w)
            if text[i:k].lower() == w and text[i:k].isascii():
                k += text[k : k + 1] in ("'", '"')
                while text[k : k + 1] == " ":
                    k += 1
                if text[k : k + 1] in (":", "="):
                    k += 1
                    while text[k : k + 1] == " ":
                        k += 1
                    k += text[k : k + 1] in ("'", '"')
                    e = k
                    while e < len(text) and text[e] in value:
                        e += 1
                    if e > k:
                        return e, e - k >= 6
        return None

    def run(chars, head, least):
        def match(i):
            e = i + len(head)
            if text[i:e] != head:
                return None
            while e < len(text) and text[e] in chars:
                e += 1
            return (e, e - i >= least) if e > i + len(head) else None

        return match

    out = []
    for kind, match in enumerate((assign, run("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "AKIA", 20), run("0123456789abcdef", "", 24))):
        i = 0
        while i < len(text):
            found = match(i)
            if found and found[1]:
                out.append((i, kind, found[0]))
            i = found[0] if found else i + 1
    return sorted(out)


def test_secret_base_columns_match_brute_force(spark):
    rng = random.Random(31)
    parts = ["password", "Passwd", "SECRET", "toKen", "api_key", "APIkey", "apikey", "AKIA", "ABCDEFGH01234567", "0123abcdef", "deadbeef", " ", "  ", ":", "=", '"', "'", "é", "ſecret", "Kelvin", "x", "/", "\n", "hunter2", "-", ".", "_", "日本"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(2000)] + [None, "", "token=abcdef " * 3000]
    df = table(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    for r in secrets.report(df).collect():
        want = base_by_hand(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in want).encode()).hexdigest(), repr(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == k for x in want) for k in range(3)) and r.n_doubted <= len(want)
        spans = [x.split(":") for x in r.spans.split(",")] if r.spans else []
        assert [(int(s), int(e)) for k, s, e in spans if k != "cnn"] == [(s, e) for s, _, e in want] and sum(k == "cnn" for k, _, _ in spans) == r.n_cnn
    assert secrets.report(df.limit(0)).count() == 0 and len(secrets.report(table(spark, odd_rows())).collect()) == 36


def test_quality_counts(spark):
    text = "a b c a b c x # #\nline one\nline one\n \n \n"
    rows = [(1, text, "en", "a"), (2, None, None, None), (3, "ok " * 60, "xx", "a")]
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.report(table(spark, rows), labels).collect()}
    assert (got[1].n_words, got[1].n_symbols, got[1].n_dup_lines, got[1].n_repeat_words) == (13, 2, 1, 6)
    assert got[2].n_words == 0 and got[2].base_failed and not got[3].kept and got[3].n_repeat_words == 60


def test_quality_pools_strata_of_few_labels(spark):
    rng = random.Random(13)
    clean, junk = prose(rng, 60, 10_000), prose(rng, 60, 10_000) + " #" * 60
    rows = [(i, clean, "de" if i % 2 else "fr", "a") for i in range(1000)] + [(1000, junk, "es", "a")]
    labels = spark.createDataFrame([(i, 1) for i in range(1001)] + [(2000, 0)], "doc_id long, quality int")
    rows += [(2000 + i, junk, lang, "a") for i, lang in enumerate(("de", "fr", "es", "en"))]
    counted = quality.measured(table(spark, rows))
    cutoffs = quality.certified_cutoffs(counted, labels)
    assert cutoffs["de", "symbols"] == cutoffs["fr", "symbols"] == 0.05 and cutoffs["es", "symbols"] == 0.5 and ("en", "symbols") not in cutoffs
    got = {r.doc_id: r.kept for r in quality.report(table(spark, rows), labels).collect()}
    assert [got[2000 + i] for i in range(4)] == [False, False, True, True] and all(got[i] for i in range(1001))
    few = labels.where("doc_id < 500")
    assert not quality.certified_cutoffs(counted, few)


def test_rolling_is_by_content():
    a, b = textkit.hash_words("x a b c y"), textkit.hash_words("a  b\tc")
    assert textkit.rolling(a[0], 3)[1] == textkit.rolling(b[0], 3)[0] and textkit.rolling(b[0], 4).size == 0


LONG = "A long, plain sentence of the article. " * 20


def test_html_names_do_not_erase_an_article():
    article = f"<h1>Head</h1><p>{LONG}</p><p><a href=x>See this.</a></p><p>Short end.</p>"
    want = ["Head", LONG.strip(), "See this.", "Short end."]
    around = [('<div class="content no-sidebar">', "</div>"), ('<div class="page has-sidebar">', "</div>"), ('<div class="article-header">', "</div>"), ('<div class="post-with-comments">', "</div>"), ("<form action=x>", "</form>"), ("<main><header>", "</header></main>"), ('<div role="main">', "</div>"), ("<nav>", "")]
    for open_, close in around:
        page = f"<body><div class=sidebar><p>A side, of text.</p></div>{open_}{article}{close}<div id=user-comments><p>I like it, very much.</p></div><footer>end</footer></body>"
        assert htmltext.main_text(page).split("\n") == want, open_
    assert htmltext.main_text("<body><nav><p>Menu, of all.</p></nav><div class=ad>Buy, now.</div></body>") == ""


def test_html_of_random_pages(spark):
    """Pages made of known article blocks and known boilerplate: exactly the blocks come back, in order."""
    rng = random.Random(21)
    noise = [
        lambda x: f"<nav><ul><li><a href=x>{x}</a></li></ul></nav>", lambda x: f"<div class='ad-slot'>{x}</div>", lambda x: f"<aside><p>{x}</p></aside>", lambda x: f"<form><label>{x}</label><input></form>",
        lambda x: f"<script>var t = '<p>{x}</p>'</script>", lambda x: f"<!-- <p>{x}</p> -->", lambda x: f"<div id=cookie-notice><p>{x}</p></div>", lambda x: f"<section class=comments><article class=comment><p>{x}</p></article></section>",
    ]
    blocks = [
        lambda x: f"<p>{x}</p>", lambda x: f"<p>{x}", lambda x: f"<h2>{x}</h2>", lambda x: f"<div><p>{x}</p></div>", lambda x: f"<blockquote>{x}</blockquote>", lambda x: f"<ul><li>{x}</li></ul>",
        lambda x: f"<p><a href=y>{x}</a></p>", lambda x: f"<table><tr><td><b>{x}</b></td></tr></table>", lambda x: f"<section>\n {x}\n</section>",
    ]
    rows, want = [], {}
    for i in range(300):
        said = [prose(rng, rng.randrange(1, 60)) + rng.choice([".", ", yes.", " &amp; so on.", ""]) for _ in range(rng.randrange(2, 12))]
        said[0] += ". " + prose(rng, 60) + "."
        inner = f"<h1>Title {i}</h1>" + "".join(rng.choice(blocks)(x) if k else f"<p>{x}</p>" for k, x in enumerate(said))
        open_, close = rng.choice([("<article>", "</article>"), ("<main><article class='post full'>", "</article></main>"), ("<main>", "</main>")])
        before, after = ("".join(rng.choice(noise)(prose(rng, rng.randrange(1, 80)) + ".") for _ in range(rng.randrange(4))) for _ in range(2))
        rows.append((i, "u", f"<html><body>{before}{open_}{inner}{close}{after}<footer>{prose(rng, 9)}</footer></body></html>", "clash"))
        want[i] = "\n".join([f"Title {i}", *(x.replace("&amp;", "&") for x in said)])
    rows += [(900, None, None, None), (901, "u", "", "x"), (902, "u", "<div>" * 5000 + f"<p>{LONG}</p>" + "</div>" * 5000, "x"), (902, "u", "<div>" * 5000 + f"<p>{LONG}</p>", "x")]
    want |= {900: "", 901: "", 902: LONG.strip()}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    got = htmltext.report(pages).collect()
    assert len(got) == len(rows) and all((r.text, r.n_chars) == (want[r.page_id], len(want[r.page_id])) for r in got), next((r.page_id, r.text, want[r.page_id]) for r in got if r.text != want[r.page_id])
    assert htmltext.report(pages.limit(0)).count() == 0


def tiles_by_hand(doc, item, least):
    """The longest match of unmarked words, again and again, by looking at all."""
    marked_doc, marked_item, out = [False] * len(doc), [False] * len(item), []
    while True:
        best = None
        for p in range(len(doc)):
            for t in range(len(item)):
                e = 0
                while p + e < len(doc) and t + e < len(item) and not marked_doc[p + e] and not marked_item[t + e] and doc[p + e] == item[t + e]:
                    e += 1
                if e >= least and (best is None or (-e, p, t) < best):
                    best = (-e, p, t)
        if best is None:
            return sorted(out)
        e, p, t = -best[0], best[1], best[2]
        marked_doc[p : p + e] = marked_item[t : t + e] = [True] * e
        out.append((p, t, e))


def test_tiles_are_those_of_the_textbook():
    rng = random.Random(41)
    for k in range(150):
        words = rng.choice([2, 3, 6, 40])
        item = [rng.randrange(words) for _ in range(rng.randrange(40))]
        doc = [rng.randrange(words) for _ in range(rng.randrange(20))]
        for _ in range(rng.randrange(4)):
            a = rng.randrange(len(item) + 1)
            doc += item[a : a + rng.randrange(30)] + [rng.randrange(words) for _ in range(rng.randrange(4))]
        assert decontaminate.tiles(np.array(doc, np.uint64), np.array(item, np.uint64)) == tiles_by_hand(doc, item, decontaminate.MIN_MATCH), k


def test_decontaminate_matches_brute_force(spark):
    """Every document against every item by the textbook's tiles, with a passage that all items share and repeated rows."""
    rng = random.Random(42)
    common = prose(rng, 8, 10_000)
    items = [(i, prose(rng, rng.randrange(1, 30), 10_000) + " " + common * (i % 2)) for i in range(30)] + [(3, "one two"), (99, common), (99, common)]
    rows = []
    for i in range(80):
        parts = [prose(rng, rng.randrange(20), 10_000)]
        for _ in range(rng.randrange(3)):
            w = rng.choice(items)[1].split()
            a, b = sorted((rng.randrange(len(w) + 1), rng.randrange(len(w) + 1)))
            parts += [" ".join(w[b:] + ["x"] + w[a:b]), prose(rng, rng.randrange(5), 10_000)]
        rows.append((i, " ".join(parts), "en", "a"))
    rows += [rows[3], (None, items[0][1], None, None), (500, "", None, None), (501, None, None, None)]
    want = []
    for i, text, _, _ in rows:
        for j, said in items:
            w = said.lower().split()
            covered = sum(x[2] for x in tiles_by_hand((text or "").lower().split(), w, decontaminate.MIN_MATCH))
            if len(w) >= decontaminate.MIN_MATCH and covered >= decontaminate.THRESHOLD * len(w):
                want.append((str(i), str(j), round(covered / len(w), 9)))
    df, b = table(spark, rows), spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, doc_id string")
    got = [(str(r.doc_id), str(r.item_id), round(r.coverage, 9)) for r in decontaminate.report(df, b).collect()]
    assert sorted(got) == sorted(want) and len(want) > 20
    leaking = {x[0] for x in want}
    assert sorted(str(r.doc_id) for r in decontaminate.drop(df, b).collect()) == sorted(str(x[0]) for x in rows if str(x[0]) not in leaking)
    assert decontaminate.drop(df, b).columns == df.columns and decontaminate.report(df.limit(0), b).count() == 0
    assert {(r.item_id, r.n_words) for r in decontaminate.unsearched(b).collect()} == {(i, len(t.split())) for i, t in items if len(t.split()) < 5}


def test_binomial_cdf_is_exact(spark):
    import math

    cases = [(k, n, p) for n in (1, 7, 60, 619, 5000) for k in sorted({0, 1, n // 100, n // 10, n}) if k <= n for p in (0.01,)]
    df = spark.createDataFrame([(k, n) for k, n, _ in cases], "k long, n long")
    got = {(r.k, r.n): r.c for r in df.select("k", "n", quality.binomial_cdf("k", "n", 0.01).alias("c")).collect()}
    for k, n, p in cases:
        want = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)) for j in range(k + 1))
        assert abs(got[k, n] - want) < 1e-8 * max(want, 1e-6), (k, n)


def test_cutoffs_and_verdicts_of_thousands_of_labels(spark):
    """Certified by an exact test of every cutoff from the loosest on, and applied by judge to all columns as they came."""
    import math

    rng = random.Random(43)
    rows = []
    for i in range(4000):
        words = [f"w{rng.randrange(10_000)}" for _ in range(60)] + ["#"] * rng.choice([0] * 150 + [2, 4, 8, 15, 40]) + ["ok!"] * rng.choice([0, 0, 1])
        rows.append((i, " ".join(words), rng.choice(["en", "en", "de"]), "a"))
    rows += [(5000 + 3 * i + k, " ".join(f"v{j}" for j in range(60)) + " #" * i, lang, "a") for i in range(0, 60, 5) for k, lang in enumerate(("en", "de", "xx"))]
    rows += [(None, None, None, None), (6000, "", "en", "a"), rows[0]]
    labels = spark.createDataFrame([(i, 1) for i in range(4000)] + [(1, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    df = spark.createDataFrame([(*x, 7, "clash") for x in rows], "doc_id long, text string, lang string, source string, n_words long, kept string").repartition(3)
    counted = quality.measured(df)
    feats = [r.asDict() for r in counted.collect()]
    ratio = {r: (lambda f, c=c: f["__qm_" + c] / max(1, f["__qm_n_words"])) for r, (c, _) in quality.RULES.items()}
    level, want = quality.DELTA / ((len(quality.LANGUAGES) + 1) * len(quality.RULES)), {}
    for stratum in ("en", "de"):
        good = [f for f in feats if f["doc_id"] is not None and f["doc_id"] < 4000 and f["doc_id"] != 2 and f["__qm_stratum"] == stratum]
        assert len(good) > 1000
        for rule, (_, grid) in quality.RULES.items():
            for cutoff in grid:
                n, k = len(good), sum(ratio[rule](f) > cutoff for f in good)
                if math.fsum(math.comb(n, j) * 0.01**j * 0.99 ** (n - j) for j in range(k + 1)) > level:
                    break
                want[stratum, rule] = cutoff
    got = quality.certified_cutoffs(counted, labels)
    assert got == want and 0.05 < got["en", "symbols"] < 2
    stays = [x for x, f in ((x, f) for x in rows for f in [next(f for f in feats if f["doc_id"] == x[0])]) if f["__qm_n_words"] >= 50 and not any(s == f["__qm_stratum"] and ratio[r](f) > c for (s, r), c in want.items())]
    out = quality.judge(df, labels)
    assert out.columns == df.columns and sorted((r.doc_id, r.text, r.n_words, r.kept) for r in out.collect()) == sorted((x[0], x[1], 7, "clash") for x in stays)
    assert quality.judge(df.limit(0), labels).count() == 0 and quality.report(df, labels.limit(0)).where("kept AND base_failed").count() == 0


def test_targets_over_ranges_of_many_sources(spark):
    rng = random.Random(44)
    sizes = [(f"s{i:05d}" if i else None, rng.choice([0, 1, 10, 1000, 100_000])) for i in range(3000)]
    df = spark.createDataFrame(sizes, "source string, source_size long").repartition(4)
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    names = sorted((s for s, _ in sizes if s), key=str) + [None]
    weight, own, total, capped = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}, dict(sizes), sum(n for _, n in sizes), {}
    while True:
        free = [s for s in own if s not in capped]
        level = (total - sum(capped.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > 3 * own[s]]
        if not over:
            break
        capped |= {s: 3 * own[s] for s in over}
    assert all(abs(got[s] - capped.get(s, level * weight[s])) < 1e-6 * total for s in own) and abs(sum(got.values()) - total) < 1e-6 * total


def test_substrings_of_an_empty_table(spark):
    assert substrings.report(table(spark, odd_rows()).limit(0)).count() == 0
