"""Near-duplicates, passages, lines, fingerprints: against plain brute-force versions."""

import hashlib
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from tabwright.llm.components import components
from tabwright.llm.fingerprints import combine, containment, distinct_count, edited_fingerprints, packed, resemblance, sketches, unpacked
from tabwright.llm.lines import BITS, DISTANCE, block_keys, without_repeated_lines
from tabwright.llm.near_duplicates import Settings, estimated_resemblance, near_duplicates, register_minima
from tabwright.llm.passages import without_repeats
from tabwright.session import Scratch

WORD = re.compile("[^\x20\x09-\x0d]+")


def prose(draw, n, vocabulary=400):
    return [f"w{draw.randrange(vocabulary)}" for _ in range(n)]


def copies(draw, n, edits):
    base, out = prose(draw, 120), []
    for _ in range(n):
        words = list(base)
        for _ in range(draw.randint(0, edits)):
            words[draw.randrange(len(words))] = f"e{draw.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def corpus(seed=5):
    draw = random.Random(seed)
    texts = [" ".join(prose(draw, draw.randint(1, 150))) for _ in range(60)] + copies(draw, 40, 4) + copies(draw, 12, 12) + ["Same Text here now"] * 5
    texts += [texts[3].upper(), "a b", "a b", "B a"]
    draw.shuffle(texts)
    return texts


def shingles(text, width):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) or frozenset([tuple(words)] if words else [])


def smallest_ids(rows, width, percent):
    sets = [shingles(t, width) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, (doc_id, _, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc_id)
    return [min((x for x in groups[find(i)] if x is not None), default=None) if sets[i] else rows[i][0] for i in range(len(rows))], sets


def as_text(values):
    return sorted(map(repr, values))


def test_near_duplicates_equal_all_pairs(docs_of, awkward):
    rows = [(100 + i, t, "en") for i, t in enumerate(corpus())] + awkward
    for words, percent in ((3, 85), (5, 80)):
        ids, sets = smallest_ids(rows, words, percent)
        got = near_duplicates(docs_of(rows), Settings(words, percent)).collect()
        assert as_text((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == as_text(
            (d, len(s), c, d == c) for (d, _, _), s, c in zip(rows, sets, ids, strict=True)
        )
    assert near_duplicates(docs_of([])).count() == 0


def test_pairs_of_other_templates_grow_in_proportion(docs_of, monkeypatch):
    """Buckets hold a template and another one just below the threshold: the pairs to confirm besides the stars grow in
    proportion to a template's texts. Texts of two templates that both fail with the hub are still compared where they
    differ from it in the same places, which is why the third one here is allowed more."""
    from tabwright.llm import near_duplicates as module

    inner, counted = module.open_pairs, []

    def counting(apart, settings):
        found = inner(apart, settings)
        counted.append(found.count())
        return found

    monkeypatch.setattr(module, "open_pairs", counting)

    def family(draw, words, n, first):
        out = []
        for k in range(n):
            own = list(words)
            own[draw.randrange(len(own))] = f"own{first + k}"
            out.append((first + k, " ".join(own), "en"))
        return out

    def pairs(n, third):
        draw = random.Random(3)
        one = [f"w{draw.randint(0, 10**6)}" for _ in range(300)]
        two, three = list(one), list(one)
        for k in range(0, 300, 20):
            two[k] = f"two{k}"
        for k in range(10, 300, 18):
            three[k] = f"three{k}"
        rows = family(draw, one, 2 * n, 0) + family(draw, two, n, 10_000) + (family(draw, three, n, 20_000) if third else [])
        got = {r.doc_id: r.component_id for r in near_duplicates(docs_of(rows)).collect()}
        sets = {i: {tuple(w[k : k + 3]) for k in range(298)} for i, t, _ in rows for w in [t.split()]}
        near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
        assert near(0, 1) and not near(0, 10_000) and not (third and (near(0, 20_000) or near(10_000, 20_000)))
        assert all(got[i] == i // 10_000 * 10_000 for i in got)
        return counted.pop()

    few, many, three = pairs(20, False), pairs(60, False), pairs(60, True)
    assert many <= 3 * few + 60 and three < 60 * 59 // 2


def test_registers_merge_and_estimate():
    draw = np.random.default_rng(1)
    a, b, c = (draw.integers(0, 2**63, n, dtype=np.uint64) for n in (900, 50, 50))
    one, two = np.sort(np.concatenate([a, b])), np.sort(np.concatenate([a, c]))
    m = 1200
    registers = register_minima(np.concatenate([one, two, np.union1d(one, two)]), np.array([0, 950, 1900, 2900]), m)
    assert (np.maximum(registers[0], registers[1]) == registers[2]).all()
    near = estimated_resemblance(registers[:1], registers[1:2], np.array([950]), np.array([950]))[0]
    assert abs(near - 0.9) < 0.05


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 140)] + [(200, 200), (201, 202)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect())
    assert got == {**{i: 0 for i in range(31)}, **{k: 100 for k in range(100, 140)}, 201: 201, 202: 201}


def removed(rows, window):
    words = [WORD.findall(t or "") for _, t, _ in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    for (doc_id, _, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        yield doc_id, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)


def test_passages_equal_brute_force(docs_of, awkward):
    draw = random.Random(8)
    passage = prose(draw, 60)
    rows = list(awkward)
    for i in range(120):
        words = prose(draw, draw.randint(0, 120))
        if i % 3 == 0:
            low, high = sorted(draw.sample(range(61), 2))
            words = words + passage[low:high] + prose(draw, 20)
        if i % 11 == 0:
            words = words + passage + passage
        rows.append((500 + i, draw.choice([" ", "\n", " \t"]).join(words), "en"))
    rows += copies_of_rows(draw)
    for group in (50_000, 40):  # the second splits groups by longer prefixes and leaves some nodes without a tree
        got = without_repeats(docs_of(rows), 35, group).collect()
        assert as_text((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == as_text(removed(rows, 35))
    assert without_repeats(docs_of([])).count() == 0


def copies_of_rows(draw):
    return [(900 + i, t, "en") for i, t in enumerate(copies(draw, 30, 3))]


def test_lines_keep_one_of_each_group(docs_of, awkward):
    line = "The Quick brown fox jumps over the lazy dog near 12 river banks"
    other = "completely different content that is long enough to be judged here"
    rows = awkward + [
        (20, f"{line}\n\n{other}\nshort one", "en"),
        (21, f"{line.lower()}!!\nshort one\n{other.upper()} ...", "en"),
        (22, f"first of all\n{line.replace('12', '99')}\nsomething that nobody else has said in this table", "en"),
    ]
    docs = docs_of(rows)
    got = {r.row.doc_id: r for r in without_repeated_lines(docs).collect() if r.row.doc_id is not None}
    assert got[20].kept_text == f"{line}\n\n{other}\nshort one"
    assert (got[21].kept_text, got[21].n_removed, got[21].n_lines) == ("short one", 2, 3)
    assert got[22].kept_text == "first of all\nsomething that nobody else has said in this table"
    assert got[2].kept_text is None and got[1].kept_text == "" and got[7].kept_text == "word " * 30_000
    assert without_repeated_lines(docs).count() == len(rows)
    assert without_repeated_lines(docs_of([])).count() == 0


def test_lines_with_one_edit_go(docs_of):
    draw = random.Random(12)
    rows, edited = [], []
    for i, size in enumerate([2, 3, 4, 6, 8, 12, 20, 40] * 8):
        words = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(4, 7))) for _ in range(size)]
        line = " ".join(words)
        at = draw.choice([k for k, c in enumerate(line) if c != " "])
        copies = [line[:at] + "é" + line[at + 1 :], line[:at] + line[at + 1 :], line[:at] + "é" + line[at:]]
        if size >= 12:
            k = draw.randrange(size)
            copies.append(" ".join([*words[:k], "é" * len(words[k]), *words[k + 1 :]]))
        for copy in copies:
            if len(line) >= 10 or len(copy) >= 10:
                rows += [(len(rows), line, "en"), (len(rows) + 1, copy, "en")]
                edited.append(len(rows) - 1)
    left = {r.row.doc_id for r in without_repeated_lines(docs_of(rows)).collect() if r.kept_text}
    assert sum(i in left for i in edited) <= 0.02 * len(edited)
    apart = [(i, " ".join("".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(9)), "en") for i in range(300)]
    assert all(r.n_removed == 0 for r in without_repeated_lines(docs_of(apart)).collect())


def test_short_lines_go_as_equal_copies(docs_of):
    rows = [(1, "All rights reserved.\nYes\n\n今日は良い天気なので公園まで散歩に行きました", "en"), (2, "all rights reserved\nno\n\nYES!", "en"), (3, "今日は良い天気なので公園まで散歩に行きました\nyet", "ja"), (4, "yes", "en")]
    got = {r.row.doc_id: r.kept_text for r in without_repeated_lines(docs_of(rows), shortest=1).collect()}
    assert got == {1: rows[0][1], 2: "no\n", 3: "yet", 4: ""}
    got = {r.row.doc_id: r.kept_text for r in without_repeated_lines(docs_of(rows), shortest=1, lone=10).collect()}
    assert got == {1: rows[0][1], 2: "no\n", 3: "yet", 4: "yes"}
    got = {r.row.doc_id: r.kept_text for r in without_repeated_lines(docs_of(rows)).collect()}
    assert got == {1: rows[0][1], 2: "no\n\nYES!", 3: "yet", 4: "yes"}


def test_near_values_share_a_block_key(spark):
    draw = random.Random(2)
    pairs = []
    for _ in range(200):
        a = draw.getrandbits(BITS)
        b = a
        for bit in draw.sample(range(BITS), DISTANCE):
            b ^= 1 << bit
        pairs.append((a - (1 << 63), b - (1 << 63)))
    frame = spark.createDataFrame(pairs, "a long, b long")
    assert frame.where(~F.arrays_overlap(block_keys(F.col("a")), block_keys(F.col("b")))).count() == 0


def test_fingerprints_follow_next_documents(docs_of):
    draw = random.Random(6)
    rows = [(i * 7, " ".join(prose(draw, draw.randint(0, 60))), "en") for i in range(40)] + [(1000, None, "en"), (1001, "", "en"), (1002, "né " * 900, "en")]
    shuffled = rows[:]
    draw.shuffle(shuffled)
    got = {r.doc_id: r for r in edited_fingerprints(docs_of(shuffled)).collect()}
    assert len(got) == len(rows)
    for k, (doc_id, text, _) in enumerate(rows):
        text, other = text or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + other[:cut] if cut else text
        row = got[doc_id]
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())

        def grams(t):
            return {t[i : i + 12] for i in range(len(t) - 11)} or ({t} if t else set())

        def near(x, y):
            return len(x & y) / len(x | y) if x | y else 1.0

        assert abs(row.near_edited - near(grams(text), grams(edited))) < 0.2
        assert abs(row.near_next - near(grams(text), grams(other))) < 0.2
        if edited == text:
            assert row.fingerprint == row.edited_fingerprint


def test_fingerprints_of_awkward_rows(docs_of, awkward):
    got = edited_fingerprints(docs_of(awkward)).collect()
    assert len(got) == len(awkward)
    assert len({r.fingerprint for r in got if r.n_chars == 3}) == 1
    assert edited_fingerprints(docs_of([])).count() == 0
    assert [r.near_next for r in edited_fingerprints(docs_of([(1, "only one", "en")])).collect()] == [1.0]


def test_sketches_merge_and_estimate():
    points = np.array([ord(c) for c in " ".join(prose(random.Random(4), 3000, 10**6))], np.uint32)
    half = len(points) // 2
    whole, left, right = (sketches(p, np.array([0, len(p)]))[0] for p in (points, points[: half + 11], points[half:]))
    assert combine([packed(left), packed(right)]) == packed(whole)
    assert (unpacked(packed(whole)) == whole).all()
    assert abs(distinct_count(whole) / len(points) - 1) < 0.3
    assert abs(resemblance(left, whole) - 0.5) < 0.15 and containment(left, whole) > 0.75


def test_lines_of_one_passage_are_compared_in_tiles(spark, monkeypatch):
    """Lines that share a passage and differ elsewhere: their pairs are not rows, whatever tiles they are dealt into."""
    from tabwright.llm import lines as module

    draw = random.Random(8)
    word = lambda n: "".join(draw.choice("abcdefghijklmnop") for _ in range(n))
    passage = " ".join(word(7) for _ in range(40))
    texts = [" ".join(word(6) for _ in range(draw.randint(6, 40))) + " " + passage for _ in range(90)]
    texts += [t.replace(t[:5], "zzzzz", 1) for t in texts[::4]] + [" ".join(word(6) for _ in range(3)) + " " + passage for _ in range(12)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    inner, found = module.linked_in_tiles, []

    def spied(loose, plain, similarity):
        links = inner(loose, plain, similarity)
        found.append((loose.count(), links.count()))
        return links

    monkeypatch.setattr(module, "linked_in_tiles", spied)

    def gone(large, chars, per_tile):
        for name, value in (("LARGE", large), ("TILE_CHARS", chars), ("TILE_ROWS", per_tile)):
            monkeypatch.setattr(module, name, value)
        return {r.row.doc_id for r in without_repeated_lines(rows).collect() if r.n_removed}

    by_join = gone(10**9, 100_000, 250)
    assert not found and len(by_join) >= 23
    assert gone(2, 100_000, 250) == by_join and gone(2, 4_000, 10) == by_join
    assert all(members > 50 for members, _ in found) and found[0][1] == found[1][1]


def test_lines_leave_no_intermediate_tables(spark, monkeypatch):
    """What lies in the shared folder at once is little beside the keys of all lines, in however many parts those and the texts go."""
    from tabwright.llm import lines as module

    draw = random.Random(21)
    words = lambda n: " ".join("".join(draw.choices("abcdefghijklmnop", k=7)) for _ in range(n))
    passage = words(30)
    texts = ["\n".join(words(9) for _ in range(8)) for _ in range(300)]
    texts += [t.replace(t[3], "é", 1) for t in texts[::3]]
    texts += [f"{words(draw.randint(4, 20))} {passage}" for _ in range(60)]
    texts += [t.replace(t[:5], "zzzzz", 1) for t in texts[-60::4]]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    folder, inner, kept = Path(spark.conf.get("spark.checkpoint.dir")), module.Scratch.table, []
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*.parquet"))

    def table(self, df):
        out = inner(self, df)
        kept.append(size())
        return out

    monkeypatch.setattr(module.Scratch, "table", table)

    def found(**settings):
        for name, value in settings.items():
            monkeypatch.setattr(module, name, value)
        kept.clear()
        before = size()
        result = without_repeated_lines(rows)
        assert kept[0] - before > 100_000 and max(kept) - before < 1.5 * (kept[0] - before) and size() - before < 0.2 * (kept[0] - before)
        return len(kept), {(r.row.doc_id, r.kept_text, r.n_removed) for r in result.collect()}

    few, whole = found(KEY_PARTS=1, TEXT_PARTS=1, LARGE=8)
    many, parts = found(KEY_PARTS=3, TEXT_PARTS=5, PART_CHARS=1)
    assert parts == whole and sum(n for _, _, n in whole) >= 800 and many > few + 2 * 2 + 4
