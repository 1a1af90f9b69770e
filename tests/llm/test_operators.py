"""The operators against plain versions on small rows: nulls, empty and long texts, ties, repeats, clashing names."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from arborlens.llm import common, embeddings, language, near, packing, passages, pseudonyms, quality, repetition, segmentation, templates

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slot long, line long, form string"


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def corpus(seed=1, n=40):
    """Random texts, copies, near copies, a shared line, a shared passage, null, empty and long ones."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(1, 160)) for _ in range(n)] + [None, "", " \n ", "a", "one two three"]
    base = prose(rng, 150)
    for _ in range(12):
        words = base.split()
        for _ in range(rng.randint(0, 7)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(9)}"
        texts.append(" ".join(words))
    texts += [base, base.upper(), texts[0], texts[0]]
    passage = prose(rng, 60, 10_000)
    texts += [f"{prose(rng, 30)} {passage} {prose(rng, 30)}\nAll rights reserved {i}" for i in range(6)]
    texts.append(prose(rng, 9000))
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), 7, 7, "f") for i, t in corpus()]
    return spark.createDataFrame(rows + [(None, "text without a key", None, None, None, 7, 7, "f")], SCHEMA)


def links(sets):
    """Smallest id reachable for each id."""
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def word_sets(rows):
    out = {}
    for i, t in rows:
        w = WORD.findall(fold(t))
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def test_near_components(docs):
    sets = word_sets(corpus())
    want = links(sets)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_components(docs).collect()}
    assert got.pop(None) == (0, None)
    assert got == {i: (len(sets[i]), want[i]) for i in sets}
    assert len(set(want.values())) < len(want) - 5


def test_repetition():
    rng = random.Random(2)
    texts = [None, "", "a a a a", "é é é # b\n\n x\nx\n x"] + [prose(rng, rng.randint(0, 60), rng.choice([2, 5, 50])) for _ in range(60)]
    got = []
    for _, _, data, offsets in common.text_slices(pa.array(texts), 300):
        got += list(zip(*[c.tolist() for c in repetition.measure(data, offsets, 5)]))
    for text, row in zip(texts, got):
        w = WORD.findall(text or "")

        def cover(size):
            runs = [tuple(w[i : i + size]) for i in range(len(w) - size + 1)]
            times = Counter(runs)
            return len({i + k for i, r in enumerate(runs) if times[r] > 1 for k in range(size)})

        longest = max([k for k in range(1, len(w) + 1) if cover(k)], default=0)
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        assert row == (len(w), sum(map(len, w)), (text or "").count("#"), len(lines) - len(set(lines)), cover(3), cover(5), longest)


def test_passages(docs):
    rows = dict(corpus())
    words = {i: WORD.findall(fold(t)) for i, t in rows.items()}
    seen = defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - 49):
            seen[tuple(w[k : k + 50])].add(i)
    truth = {i for who in seen.values() if len(who) > 1 for i in who}
    found = passages.repeated_passages(docs).collect()
    assert truth <= {r.doc_id for r in found} and len(truth) > 6
    for r in found:
        a = words[r.doc_id][r.start : r.start + r.n_words]
        b = words[r.other][r.other_start : r.other_start + r.n_words]
        assert len(a) == len(b) == r.n_words and sum(x == y for x, y in zip(a, b)) >= 0.8 * len(a)


def exact_repeats(rows, width=50):
    """Documents that have a run of ``width`` words of another document, and which documents have that run."""
    seen = defaultdict(set)
    for i, t in rows:
        w = WORD.findall(fold(t))
        for k in range(len(w) - width + 1):
            seen[tuple(w[k : k + width])].add(i)
    return [who for who in seen.values() if len(who) > 1]


def test_run_pairs_connect_what_shares_a_run(spark):
    rng = random.Random(8)
    rows = [(i, t) for i, t in corpus(seed=8) if t] + [(500 + k, prose(rng, 49)) for k in range(2)]
    rows += [(600, rows[3][1] + " tail"), (601, prose(rng, 50, 10**6)), (-4, rows[0][1])]
    codes = defaultdict(lambda: len(codes))
    packed = [(i, np.array([codes[w] for w in WORD.findall(fold(t))], "<u4").tobytes()) for i, t in rows if t.split()]
    words = spark.createDataFrame(packed, "id long, words binary").repartition(3)
    pairs = {(r.doc, r.first) for r in passages.run_pairs(words, 50, 7).collect()}
    groups = exact_repeats(rows)
    assert groups and all(a > b and any({a, b} <= who for who in groups) for a, b in pairs)
    for who in groups:
        # Every document with a run is linked to the first one, directly or through the first one of its slice.
        reached = {min(who)}
        while more := {a for a, b in pairs if a in who and b in reached} - reached:
            reached |= more
        assert reached == who


def test_a_first_document_that_only_shares_keys_hides_nothing(spark, monkeypatch):
    """One document has pieces of all passages, too short to count, so that keys name it first."""
    rng = random.Random(21)
    rows, want = [], []
    for g in range(25):
        passage = prose(rng, 56, 10**6).split()
        loose = [w if k % 11 < 8 else f"z{rng.randrange(10**6)}" for k, w in enumerate(passage)]
        for k, words in enumerate((loose, passage, passage)):
            rows.append((3 * g + k, " ".join([prose(rng, 60, 10**6), *words, prose(rng, 60, 10**6)])))
        want.append((3 * g + 2, 3 * g + 1))

    def first_only(found, functions, need):
        # All documents of a group have one key and no other: the worst that chance can do.
        doc = np.unique(found["doc"].to_numpy(np.int64))
        return doc // 3, doc

    monkeypatch.setattr(passages, "interval_keys", first_only)
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert {(r.doc_id, r.other) for r in found.where("NOT first").collect()} == set(want)


def test_a_first_document_hides_no_near_copy(spark, monkeypatch):
    """As above, but the two others are near copies without a whole passage in common, one of each in another partition."""
    rng = random.Random(22)
    rows, want = [], []
    for g in range(12):
        passage = prose(rng, 60, 10**6).split()
        loose = [w if k % 11 < 8 else f"z{rng.randrange(10**6)}" for k, w in enumerate(passage)]
        for k, words in enumerate((loose, passage, edited(rng, passage, "+-="[g % 3]))):
            rows.append((3 * g + k, " ".join([prose(rng, 60, 10**6), *words, prose(rng, 60, 10**6)])))
        want.append((3 * g + 2, 3 * g + 1))
    monkeypatch.setattr(passages, "interval_keys", group_keys())
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert {(r.doc_id, r.other) for r in found.where("NOT first").collect()} == set(want)


def test_a_first_document_with_one_passage_hides_no_other(spark, monkeypatch):
    """All three share a passage; the first one has the other passage in loose words only."""
    rng = random.Random(23)
    rows = []
    for g in range(12):
        one, two = (prose(rng, 60, 10**6).split() for _ in range(2))
        loose = [w if k % 11 < 8 else f"z{rng.randrange(10**6)}" for k, w in enumerate(two)]
        for k, words in enumerate((loose, two, two)):
            rows.append((3 * g + k, " ".join([prose(rng, 40, 10**6), *one, prose(rng, 30 + 7 * k, 10**6), *words, prose(rng, 40, 10**6)])))
    monkeypatch.setattr(passages, "interval_keys", group_keys())
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).where("NOT first").collect()
    for g in range(12):
        assert {(r.other, r.start, r.n_words) for r in found if r.doc_id == 3 * g + 2} >= {(3 * g, 40, 60), (3 * g + 1, 144, 60)}


def group_keys():
    """Three documents of a group have one key and no other. Defined here, so that it travels with the job."""

    def keys(found, functions, need):
        doc = np.unique(found["doc"].to_numpy(np.int64))
        return doc // 3, doc

    return keys


def test_runs_of_one_origin_are_not_paired(spark):
    rng = random.Random(24)
    shared = prose(rng, 60, 10**6).split()
    codes = defaultdict(lambda: len(codes))
    rows = []
    for i in range(6):
        text = prose(rng, 20, 10**6).split() + shared
        # 1 to 3 go back to document 0, which is not there itself; 4 and 5 are known from nowhere.
        rows.append((i + 1, np.array([codes[w] for w in text], "<u4").tobytes(), [(20, 60, 0)] if i < 3 else None))
    words = spark.createDataFrame(rows, "id long, words binary, spans array<struct<start:long,n_words:long,other:long>>")
    for spread in (1, 6):
        pairs = {(r.doc, r.first) for r in passages.run_pairs(words.coalesce(1), (45, 20), 7, spread).collect()}
        assert pairs == {(4, 1), (5, 1), (6, 1)}
    assert passages.near_run(50, 0.8) == 25


def edited(rng, words, edits):
    """Words put in (+), left out (-) or replaced (=) at even distances."""
    out = list(words)
    for k, kind in reversed(list(enumerate(edits, 1))):
        at = len(words) * k // (len(edits) + 1)
        out[at : at + (kind != "+")] = [] if kind == "-" else [f"new{rng.randrange(10**6)}"]
    return out


@pytest.mark.parametrize("n, edits", [(60, "+"), (60, "-"), (80, "+"), (88, "-"), (120, "+-"), (200, "+-="), (400, "-+-+=")])
def test_passages_with_words_put_in_or_left_out(n, edits):
    rng = random.Random(n)
    passage = [f"p{rng.randrange(10**6)}" for _ in range(n)]
    a = prose(rng, 70, 10**6).split() + passage + prose(rng, 30, 10**6).split()
    b = prose(rng, 20, 10**6).split() + edited(rng, passage, edits) + prose(rng, 90, 10**6).split()
    x, y = word_sets([(0, " ".join(passage)), (1, " ".join(edited(rng, passage, edits)))]).values()
    assert 0.8 <= len(x & y) / len(x | y) <= 0.95
    codes = {w: k for k, w in enumerate({*a, *b})}
    x, y = (passages.shingled(np.array([codes[w] for w in t], "<u4")) for t in (a, b))
    assert passages.near_passages(x, y, 50, 0.8) == [(70, 70 + n, 20, len(b) - 90)]


def test_near_passages_are_found(spark):
    rng = random.Random(3)
    rows, want = [], set()
    for i in range(0, 200, 2):
        passage = prose(rng, 60, 10**6).split()
        for k, words in ((i, passage), (i + 1, edited(rng, passage, "+-="[i // 2 % 3]))):
            rows.append((k, " ".join([prose(rng, 40, 10**6), *words, prose(rng, 40, 10**6)])))
        want.add((i + 1, i))
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).where("NOT first").collect()
    found = {(r.doc_id, r.other) for r in found}
    assert found <= want and len(found) >= 95


def test_compact_windows_are_the_wide_nodes_of_the_tree():
    rng = np.random.default_rng(4)
    doc = np.sort(rng.integers(0, 4, 200))
    _, doc = np.unique(doc, return_inverse=True)
    h, width = rng.integers(0, 60, 200).astype(np.uint64), 7
    got = set(zip(*(x.tolist() for x in passages.compact_windows(h, doc, width))))
    want = set()
    for c in range(200):
        a = b = c
        while a and doc[a - 1] == doc[c] and h[a - 1] > h[c]:
            a -= 1
        while b + 1 < 200 and doc[b + 1] == doc[c] and h[b + 1] >= h[c]:
            b += 1
        if b - a + 1 >= width:
            want.add((a, c, b))
    assert got == want


def test_templates(docs, spark):
    out = {r.doc_id: r for r in templates.drop_recurring_lines(docs).collect()}
    rows = dict(corpus())
    marked = [i for i, t in rows.items() if t and "All rights reserved" in t]
    # The six lines differ in a digit field only: one template; the first one stays.
    assert "All rights reserved" in out[marked[0]].text and out[marked[0]].n_dropped == 0
    assert all("All rights reserved" not in out[i].text for i in marked[1:])
    assert out[None].text == "text without a key" and out[40].text is None and out[41].text == ""
    assert len(out) == docs.count() and out[0].slot == 7
    lone = spark.createDataFrame([(i, f"same words here now {i}") for i in range(3)], "doc_id long, text string")
    assert all(r.n_dropped == 0 for r in templates.drop_recurring_lines(lone).collect())
    assert templates.drop_recurring_lines(lone.limit(0)).count() == 0


def test_templates_that_recur_in_two_documents(spark):
    long_ = "this notice was printed on {} and may be shared by anyone who keeps it whole"
    lines = [
        ("short exact line 7", "short exact line 7", True),
        ("short masked line 7", "short masked line 8", False),
        (long_.format("2021-03-04"), long_.format("2022-05-06"), True),
        ("all shops of the town close early on monday as they have always done", "all shops of the town close early on friday as they have always done", True),
        ("本网站的全部内容均受版权保护", "本网站的全部内容均受版权保护", True),
        ("https://example.com/a/long/link?id=1", "https://example.com/a/long/link?id=1", True),
        ("https://example.com/another/link?id=1", "https://example.com/another/link?id=2", False),
        ("1 2 3 4 5 6 7 8 9 10 11 12", "2 3 4 5 6 7 8 9 10 11 12 13", False),
        ("}", "}", False),
    ]
    rows = [(n, "\n".join(x[n] for x in lines)) for n in (0, 1)]
    one, two = sorted(templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert one.text == rows[0][1] and one.n_dropped == 0
    assert two.text == "\n".join(b for _, b, goes in lines if not goes)


def test_packing_ids_and_places(docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    reference = Tokenizer.from_file(path)
    reference.encode_special_tokens = True
    rng = random.Random(3)
    alphabet = ["a", "b", " ", "\n", "\t", "é", "à ", "'s", "'", "1", ".", ",", "<|endoftext|>", "　", "中", "\r", "\x85", "…"]
    odd = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(800)]
    encoder = packing.Encoder(path)
    for first, last, data, offsets in common.text_slices(pa.array([*odd, *[t for _, t in corpus()]]), 2000):
        ids, counts = encoder.encode(data, offsets)
        texts = [*odd, *[t for _, t in corpus()]][first:last]
        assert np.split(ids, np.cumsum(counts)[:-1])[0].tolist() == reference.encode(texts[0] or "", add_special_tokens=False).ids
        assert ids.tolist() == [i for t in texts for i in reference.encode(t or "", add_special_tokens=False).ids]
    placed = packing.pack(packing.token_pieces(docs.where("doc_id IS NOT NULL"), path)).collect()
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in placed:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append((r.offset, r.length))
    for i, t in corpus():
        ids = [*reference.encode(t or "", add_special_tokens=False).ids, 0]
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces))) and sum(r.length for r in pieces) == len(ids)
        for r in pieces:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for items in by_bin.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 2048


def test_packing_is_optimal_on_small_instances():
    def fewest(items, capacity):
        best = [len(items)]

        def place(k, bins):
            if len(bins) >= best[0]:
                return
            if k == len(items):
                best[0] = len(bins)
                return
            for room in {b for b in bins if b + items[k] <= capacity}:
                i = bins.index(room)
                place(k + 1, bins[:i] + [room + items[k]] + bins[i + 1 :])
            place(k + 1, [*bins, items[k]])

        place(0, [])
        return best[0]

    rng = random.Random(5)
    over = 0
    for _ in range(60):
        items = sorted((rng.randint(2, 20) for _ in range(rng.randint(1, 9))), reverse=True)
        bins = packing.pack_counts(dict(Counter(items)), 20)
        assert Counter(x for p, n in bins for x in list(p) * n) == Counter(items) and all(sum(p) <= 20 for p, _ in bins)
        over += sum(n for _, n in bins) - fewest(items, 20)
    assert over <= 1


def test_ids_are_those_of_the_encoder(docs):
    """Whole texts, and odd ones: ties of merges, blanks, characters without a piece, long words without blanks."""
    import time

    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(6)
    texts = [t or "" for _, t in corpus()] + ["aaaaaaa aaaa aaaaaaaaa", "  a   b  ", "\n\n a", "\t", " ", "a ", "🙂é" + "abcdefghij" * 40, "x" * 700]
    texts += ["".join(rng.choice("aabbehnt  .,é中") for _ in range(rng.randint(1, 90))) for _ in range(600)]
    segmenter = segmentation.Segmenter(path)
    assert [np.frombuffer(c, "<u4").tolist() for c in segmenter.encode(texts)] == own.encode(texts)
    long_ = "中文文本没有空格也很长，" * 6000
    started = time.monotonic()
    assert np.frombuffer(segmenter.encode([long_])[0], "<u4").tolist() == own.encode(long_) and time.monotonic() - started < 4
    rows = segmentation.segment_documents(docs, path).collect()
    assert all(r.same for r in rows) and len(rows) == docs.count() and all(r.ids == [] for r in rows if r.doc_id in (40, 41))
    assert all(r.ids == own.encode(dict(corpus())[r.doc_id] or "") for r in rows if r.doc_id is not None)


def test_stable_pairs_against_plain_merges():
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = segmentation.Pieces(path)
    place = {pieces.text[i].decode().replace(" ", "▁"): int(pieces.rank[i]) for i in np.flatnonzero(pieces.chars)}

    def merged(symbols):
        while True:
            found = min(((place[x + y], k) for k, (x, y) in enumerate(zip(symbols, symbols[1:])) if x + y in place), default=None)
            if found is None:
                return symbols
            symbols = [*symbols[: found[1]], symbols[found[1]] + symbols[found[1] + 1], *symbols[found[1] + 2 :]]

    rng = np.random.default_rng(3)
    known = np.flatnonzero(pieces.built)
    left, right = rng.choice(known, 4000), rng.choice(known[pieces.chars[known] < 4], 4000)
    words = [[pieces.text[i].decode().replace(" ", "▁") for i in pair] for pair in zip(left, right)]
    want = [merged(list(a + b)) == [a, b] for a, b in words]
    assert pieces.stable(left, right).tolist() == want and pieces.stable(left, right).tolist() == want and 0 < sum(want) < 4000


def test_pseudonyms(docs):
    key = b"k"
    for n in (1, 2, 3, 10, 97, 1000):
        image = [pseudonyms.permute(x, n, key, b"t") for x in range(n)]
        assert sorted(image) == list(range(n)) and [pseudonyms.permute(x, n, key, b"t", True) for x in image] == list(range(n))
    text = (
        "a.b@mail1.example.com 4111111111111111 4111-1111-1111-1111 +1 (988) 555-2485 10.20.30.40 2021-03-04 "
        "04.03.2021 123-45-6789 DE89 3704 0044 0532 0130 00 password=b7db7aa4a5"
    )
    new, spans = pseudonyms.pseudonymize(text, key)
    assert [k for *_, k in spans] == ["email", "card", "card", "phone", "ipv4", "date", "date", "ssn", "iban", "entry"]
    assert pseudonyms.pseudonymize(new, key, back=True)[0] == text
    values = [new[a:b] for a, b, _ in spans]
    assert values[1] == values[2].replace("-", "") and pseudonyms.luhn_digit(values[1][:-1]) == values[1][-1]
    assert values[5].split("-") == values[6].split(".")[::-1]
    clean = "order 4111111111111112 of 999.1.1.1 on 2021-02-30, version 1.2.3"
    assert pseudonyms.pseudonymize(clean, key) == (clean, [])
    rows = {r.doc_id: r for r in pseudonyms.pseudonymize_documents(docs, key).collect()}
    assert rows[40].text is None and rows[41].text == "" and rows[0].pii_spans == [] and rows[0].slot == 7


def test_phone_numbers_that_are_not_valid():
    key = b"k"
    numbers = ["+1 (017) 555-7713", "+1 (132) 555-1352", "(017) 555-7713", "1-017-155-7713", "017.055.7713", "988-055-2485"]
    text = "call " + ", ".join(numbers) + " now"
    new, spans = pseudonyms.pseudonymize(text, key)
    values = [new[a:b] for a, b, _ in spans]
    assert [k for *_, k in spans] == ["phone"] * 6 and not set(values) & set(numbers)
    assert [re.sub(r"\d", "0", v) for v in values] == [re.sub(r"\d", "0", v) for v in numbers]
    # Written otherwise, the same number has the same pseudonym; no valid number is among them.
    national = [re.sub(r"\D", "", v)[-10:] for v in values]
    assert national[0] == national[2] and all(n[0] in "01" or n[3] in "01" for n in national)
    assert len(set(national)) == 5 and pseudonyms.pseudonymize(new, key, back=True)[0] == text


def test_forms_of_other_countries():
    key = b"k"
    values = {
        "foreign phone": ["+49 30 901820", "+44 20 7946 0958", "+33 1 42 68 53 00", "+34 912 345 678", "+49 (0)30 901820", "+4930901820"],
        "French phone": ["06 12 34 56 78", "01.42.68.53.00"],
        "short date": ["3.4.2021", "1/2/2021", "31.1.1999"],
        "written date": ["12 March 2021", "March 12, 2021", "12. März 2021", "12 mars 2021", "12 de marzo de 2021", "1 August 1999"],
        "ipv6": ["2001:db8::1", "fe80::1ff:fe23:4567:890a", "2001:0DB8:0000:0000:0000:FF00:0042:8329"],
        "iban": ["de89 3704 0044 0532 0130 00", "DE89370400440532013000"],
    }
    for kind, listed in values.items():
        for value in listed:
            text = f"see {value}, then"
            new, spans = pseudonyms.pseudonymize(text, key)
            assert [k for *_, k in spans] == [kind] and value not in new, value
            assert pseudonyms.restore(new, spans, key) == text
    one = lambda x: pseudonyms.pseudonymize(x, key)[0]
    # Linked across spellings.
    assert one("A.B@Mail.Example.com") != "A.B@Mail.Example.com" and one("A.B@Mail.Example.com").lower() == one("a.b@mail.example.com")
    assert re.sub(r"\D", "", one("+33 1 42 68 53 00"))[2:] == re.sub(r"\D", "", one("01 42 68 53 00"))[1:]
    assert one("3.4.2021") == ".".join(str(int(x)) for x in one("03.04.2021").split(".")) and one("1/2/2021").split("/")[2] == one("2021-01-02")[:4]
    assert one("de89 3704 0044 0532 0130 00") == one("DE89 3704 0044 0532 0130 00").lower()
    clean = "at 12:34:56 on 31.2.2021, 99 March 2021, ratio 3:4:5, +12, v1.2.2021.4, a::b, x::, chapter 1/2/20, 0612345678901"
    assert pseudonyms.pseudonymize(clean, key) == (clean, [])


def test_cards_beside_other_numbers():
    key, card = b"k", "4111 1111 1111 1111"
    texts = [f"{card} 12/27", f"{card} 123", f"order 12 {card}", f"2024-01-05 {card}", f"{card} 5500-0000-0000-0004 9", "12 3782 822463 10005 1234", "7 4111111111111111 08 27"]
    for text in texts:
        new, spans = pseudonyms.pseudonymize(text, key)
        cards = [(a, b) for a, b, k in spans if k == "card"]
        assert len(cards) == 1 + ("5500" in text), text
        for a, b in cards:
            digits = re.sub(r"\D", "", new[a:b])
            assert text[a:b] in (card, "5500-0000-0000-0004", "3782 822463 10005", "4111111111111111")
            assert new[a:b] != text[a:b] and pseudonyms.luhn_digit(digits[:-1]) == digits[-1]
        assert pseudonyms.restore(new, spans, key) == text


def test_vectors(spark):
    rng = np.random.default_rng(7)
    rows, n = [], 0
    for label in (0, 1):
        for _ in range(25):
            base = rng.normal(size=24)
            for _ in range(rng.integers(1, 5)):
                rows.append((n, [float(x) for x in base + rng.normal(size=24) * 0.05], label))
                n += 1
    rows += [(n, rows[0][1], 0), (n + 1, rows[0][1], 0), (n + 2, rows[0][1], None), (n + 3, None, 0), (n + 4, [0.0] * 24, 0)]
    rows += [(n + 5, [float("nan")] * 24, 0), (n + 6, [None] * 24, 0), (n + 7, [], 0), (n + 8, [1.0, 2.0], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embeddings.near_duplicates(frame, block=8).collect()}
    good = {i: np.array(v) / np.linalg.norm(v) for i, v, lab in rows if v and lab is not None and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: lab for i, _, lab in rows}
    near_ = {i: {j for j in good if j != i and label[i] == label[j] and len(good[i]) == len(good[j]) and good[i] @ good[j] >= 0.98} for i in good}
    total, found = sum(map(len, near_.values())), sum(r.n_links for r in got.values())
    assert all(got[i].n_links <= len(near_.get(i, ())) for i in got) and found >= 0.97 * total > 50
    assert got[n].component_id == 0 and not got[n].kept and got[n + 2].kept and got[n + 3].n_links == 0 and len(got) == len(rows)


def test_language(spark):
    rng = random.Random(8)
    letters = {"aa": "abcde", "bb": "fghij", "cc": "αβγδε"}
    rows = [(i, " ".join("".join(rng.choices(letters[x], k=5)) for _ in range(20)), x) for i in range(90) for x in [rng.choice(list(letters))]]
    frame = spark.createDataFrame(rows + [(90, None, "aa"), (91, "123 --", "bb"), (92, "abcde", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.predict(frame, language.fit(frame)).collect()}
    assert all(got[i].lang_pred == x and 0 <= got[i].score <= 1 for i, _, x in rows)
    assert (got[90].lang_pred, got[91].lang_pred, got[92].lang_pred) == ("und", "und", "aa")
    assert language.predict(frame, language.fit(frame.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_quality(spark):
    rng = random.Random(9)
    rows = []
    for i in range(160):
        text = prose(rng, rng.randint(20, 80))
        rows.append((i, text.upper() + " ## $$" if i % 3 == 0 else text, i % 3 != 0))
    frame = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(160, None), (161, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(g), 0) for i, _, g in rows] + [(5, None, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    learn = "doc_id % 4 <> 1"
    got = {r.doc_id: r for r in quality.quality_scores(frame, labels, learn).collect()}
    held = [(i, g) for i, _, g in rows if i % 4 == 1]
    assert all(got[i].held_out for i, _ in held) and sum((got[i].score >= 0.5) == g for i, g in held) >= 0.95 * len(held)
    assert len(got) == 162 and all(0 <= r.score <= 1 for r in got.values())
    model = quality.fit(quality.labelled_statistics(frame, labels, learn))
    assert {r.doc_id for r in quality.keep_good(frame, model).collect()} == {i for i, r in got.items() if r.score >= 0.5}
    assert quality.isotonic(np.array([1, 1, 0, 2]), np.array([1, 0, 0, 2])).tolist() == [0.5, 0.5, 1.0, 1.0]
