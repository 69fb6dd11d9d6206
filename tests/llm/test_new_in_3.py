"""Operators 11 to 13 against brute force, and odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from logsentinel.llm import conversations as C
from logsentinel.llm import simhash as H
from logsentinel.llm import spelling as S

DATA = "/root/testdata/sf0.001"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


# --- 11


def plain_fingerprint(text):
    words = [w for w in SPACE.split(lower(text)) if w]
    if not words:
        return 0
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, radius=2):
    """{fingerprint: smallest id} by all pairs; prints: (id, fingerprint)."""
    distinct, up = sorted({f for _, f in prints}), {}
    top = lambda x: x if up.get(x, x) == x else top(up[x])
    for a, b in itertools.combinations(distinct, 2):
        if (a ^ b).bit_count() <= radius:
            up[top(a)] = top(b)
    least = {}
    for i, f in prints:
        if i is not None:
            least[top(f)] = min(i, least.get(top(f), i))
    return {f: least.get(top(f)) for f in distinct}


def test_fingerprints_equal_the_plain_form():
    texts = ["", "  ", "One", "one TWO", "a b c", "Été  \t ça\nva BIEN là", "x " * 500, " ".join(map(str, range(300))), "À" * 3000 + " b c d"]
    data = "".join(texts).encode()
    offs = np.cumsum([0] + [len(t.encode()) for t in texts])
    got = H.text_fingerprints(np.frombuffer(data, np.uint8), offs)
    assert got.tolist() == [plain_fingerprint(t) for t in texts]
    before, H.CHUNK = H.CHUNK, 7
    assert H.text_fingerprints(np.frombuffer(data, np.uint8), offs).tolist() == got.tolist()
    H.CHUNK = before


def test_bk_tree_finds_all_within_the_radius():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 40, np.uint64)
    values = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(20))]))
    queries = np.concatenate([values, rng.integers(0, 2**64, 50, np.uint64)])
    before, H.BLOCK = H.BLOCK, 64
    for radius in (0, 2, 5):
        q, v = H.Tree(values).near(queries, radius)
        want = {(i, j) for i, x in enumerate(queries.tolist()) for j, y in enumerate(values.tolist()) if (x ^ y).bit_count() <= radius}
        assert set(zip(q.tolist(), v.tolist(), strict=True)) == want and len(q) == len(want)
    H.BLOCK = before
    assert all(len(x) == 0 for x in H.Tree(values[:0]).near(queries))


def test_simhash_query_equals_all_pairs(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    prints = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs]
    comp = plain_components(prints)
    want = sorted((i, f"{f:016x}", comp[f]) for i, f in prints)
    got = sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in H.op11_simhash_duplicates(spark, DATA).collect())
    assert got == want


@pytest.mark.parametrize("piece", [4, 2048])
def test_links_keep_components_in_any_shards(spark, piece, monkeypatch):
    monkeypatch.setattr(H, "PIECE", piece)
    rng = random.Random(3)
    prints = [rng.getrandbits(64) for _ in range(20)]
    for _ in range(150):
        f = rng.choice(prints)
        for _ in range(rng.randint(1, 3)):
            f ^= 1 << rng.randrange(64)
        prints.append(f)
    signed = [f - (1 << 64) if f >> 63 else f for f in set(prints)]
    edges = H.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    up = {}
    top = lambda x: x if up.get(x, x) == x else top(up[x])
    for a, b in edges:
        assert ((a ^ b) & (2**64 - 1)).bit_count() <= 2
        up[top(a)] = top(b)
    want = plain_components([(f, f & (2**64 - 1)) for f in signed])
    groups = lambda key: sorted(sorted(g) for g in _grouped(signed, key))
    assert groups(top) == groups(lambda f: want[f & (2**64 - 1)])


def _grouped(items, key):
    out = {}
    for i in items:
        out.setdefault(key(i), []).append(i)
    return out.values()


def test_simhash_odd_rows(spark):
    rows = [(5, "a b c d", 1), (5, "a b c d", 1), (None, "A b  c d", 2), (3, None, 3), (9, "", 4), (None, None, 5), (7, "x y z " * 40000, 6), (8, "x y z " * 40000 + "x", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long").withColumnRenamed("fp", "copies")
    got = [(r["doc_id"], r["component_id"]) for r in H.simhash_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted([(5, 5), (5, 5), (None, 5), (3, 3), (9, 3), (None, 3), (7, 7), (8, 7)], key=str)
    assert H.simhash_duplicates(docs.limit(0)).count() == 0
    assert [r["component_id"] for r in H.simhash_duplicates(docs.where("doc_id IS NULL AND text IS NULL")).collect()] == [None]


# --- 12


def plain_words(rows, damage=True):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if damage and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def edits_away(word, letters):
    for i in range(len(word) + 1):
        yield from (word[:i] + c + word[i:] for c in letters)
        if i < len(word):
            yield word[:i] + word[i + 1 :]
            yield from (word[:i] + c + word[i + 1 :] for c in letters)


def plain_variants(words):
    letters, out = {c for w in words for c in w}, {}
    for w, n in words.items():
        near = {x for x in edits_away(w, letters) if x in words and x != w}
        best = min(near, key=lambda x: (-words[x], x), default=None)
        out[w] = (best if best and words[best] >= 5 * n else None, len(near))
    rows = []
    for w, (form, near) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, words[w], near, words[form] if form else None))
    return sorted(rows)


def test_spelling_query_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    want = plain_variants(plain_words(docs))
    got = sorted(tuple(r) for r in S.op12_spelling_variants(spark, DATA).select("word", "form", "root", "n", "n_near", "form_n").collect())
    assert len(want) > 300 and any(r[1] for r in want)
    assert got == want


@pytest.mark.parametrize("piece", [3, 4096])
def test_near_words_in_any_pieces(spark, piece, monkeypatch):
    monkeypatch.setattr(S, "PIECE", piece)
    monkeypatch.setattr(S, "BLOCK", 50)
    rng = random.Random(8)
    words = {"".join(rng.choice("aeinst") for _ in range(rng.randint(6, 8))) for _ in range(200)} | {"x" * 40, "x" * 39 + "y", "x" * 41, "éeinst" + "z" * 30, "èeinst" + "z" * 30}
    counts = {w: rng.choice([5, 25, 26, 200]) for w in words}
    counts |= {"chainaa": 5, "chainab": 25, "chainbb": 125, "chaibbb": 625, "chabbbb": 3125}
    docs = spark.createDataFrame([(i, " ".join([w] * n)) for i, (w, n) in enumerate(counts.items())], "doc_id long, text string")
    got = sorted(tuple(r) for r in S.spelling_variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect())
    assert got == plain_variants(counts)
    assert [r for r in got if r[0] == "chainaa"][0][2] == "chabbbb"


def test_one_edit():
    assert [S.one_edit(a, b) for a, b in (("abc", "abc"), ("abc", "abd"), ("abc", "abcd"), ("abc", "xabc"), ("abc", "axc"), ("abc", "acb"), ("abc", "abcde"), ("", "a"))] == [False, True, True, True, True, False, False, True]


def test_spelling_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 16)
    text = "ÀÉbcdefg×, Straßenbahn straßenbahn2straßenbahn " * 6 + "Āabcdef’" * 5 + "z" * 100
    rows = [(1, text, "a"), (1, text, "a"), (None, text, "b"), (2, None, "c"), (3, "", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")
    assert {r["word"]: r["n"] for r in S.word_counts(docs).collect()} == plain_words([r[:2] for r in rows])
    assert S.spelling_variants(docs.limit(0)).count() == 0
    assert S.spelling_variants(docs).count() == len(plain_words([r[:2] for r in rows], False))


# --- 13


def plain_damage(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        yield from [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)


def plain_repair(rows):
    """Lightest edits of one conversation's ordered rows by trying all, shortest first: a plain table over places and states."""
    faults, seen = [], set()
    for role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated")
        seen.add((role, text))
    step = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {}  # (place, state) -> set of (cost, audit, repaired rows)

    def rest(i, state, inserts):
        key = (i, state, inserts)
        if key not in best:
            found = []
            if i == len(rows):
                if state in ("", "a"):
                    found.append((0, "", ()))
            else:
                role, text = rows[i]
                found += [(c + 4, "D" + a, r) for c, a, r in rest(i + 1, state, 0)]
                if faults[i] not in ("blank", "duplicate"):
                    more = 3 * (faults[i] == "truncated")
                    for new, cost, op in ((role, 0, "K"), ("user", 3, "R"), ("assistant", 3, "R")):
                        if new[:1] in step[state] and new[:1]:
                            found += [(c + cost + more, op + a, ((new, text), *r)) for c, a, r in rest(i + 1, new[0], 0)]
            if inserts < 3:
                for new in ("user", "assistant"):
                    if new[0] in step[state]:
                        found += [(c + 3, "I" + a, ((new, ""), *r)) for c, a, r in rest(i, new[0], inserts + 1)]
            best[key] = sorted(found)[:1]
        return best[key]

    cost, audit, repaired = rest(0, "", 0)[0]
    kinds = [r[0][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(kinds[:-1], kinds[1:], strict=True))
    return [faults.count(f) for f in ("blank", "duplicate", "truncated")] + [illegal, cost, audit], repaired


def plain_op13(table):
    out = []
    for conv in {r[0] for r in table}:
        rows = [r for r in plain_damage(r for r in table if r[0] == conv)]
        rows.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns = {r[1] for r in rows} - {None}
        numbers, repaired = plain_repair([r[2:] for r in rows])
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, *numbers, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in repaired).encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_repair_query_equals_brute_force(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in C.op13_conversation_repair(spark, DATA).select(COLUMNS).collect()), key=str)
    assert got == plain_op13(table)


def _odd_conversations():
    rng = random.Random(4)
    table = []
    for conv in [None, *range(60)]:
        for turn in [None] * rng.randrange(2) + list(range(rng.randrange(9))):
            table.append((conv, turn, rng.choice(["user", "assistant", "system", None, "tool", ""]), rng.choice(["Yes.", "No!", "Well", "\t\n", None, "Why? \x0b", "Ok. "])))
    return table + [(99, 1, "user", "long " * 50000 + "."), (99, 1, "user", "long " * 50000 + "!"), (99, 1, "assistant", "A.")]


@pytest.mark.parametrize("block", [2, 512])
def test_repair_of_odd_rows_in_any_blocks(spark, tmp_path, block, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", block)
    table = _odd_conversations()
    spark.createDataFrame([(*r, "x", 1) for r in table], "conv_id long, turn long, role string, text string, audit string, pos int").write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted((tuple(r) for r in C.op13_conversation_repair(spark, str(tmp_path)).select(COLUMNS).collect()), key=str)
    assert got == plain_op13(table)
    rows = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").where("conv_id = 99")
    planned, repaired = C.repair_conversations(rows)
    assert planned.first()["audit"] and [r["role"] for r in repaired.orderBy("place").collect()][0] == "user"
    assert all(x.count() == 0 for x in C.repair_conversations(rows.limit(0)))


def test_long_conversation_in_blocks_equals_one_block():
    rng = random.Random(2)
    for n in (1, 5, 40, 300):
        codes = bytes(rng.choice([0, 1, 2, 3, 5, 6, 13, 14, 9, 10]) for _ in range(n))
        blocks = [C.solve(codes[i : i + 7]) for i in range(0, n, 7)]
        assert C.chained(blocks) == C.chained([C.solve(codes)])


# --- what was mended


def test_licences_with_typographic_marks(spark):
    from logsentinel.llm import licenses as L

    of = dict(reversed(L.LICENSES))
    fancy = lambda t: t.replace('"Software"', "“Software”").replace('"AS IS"', "“AS IS”").replace("'", "’").replace("-", "‐").replace("free of charge", "free of charge")
    docs = spark.createDataFrame([(i, "• " + fancy(of[k])) for i, k in enumerate(("MIT", "BSD-3-Clause", "ISC"))], "doc_id long, text string")
    known, notices = spark.createDataFrame(L.LICENSES, "license string, text string"), spark.createDataFrame(L.NOTICES, "license string, text string")
    assert [r["license"] for r in L.scan_licenses(docs, known, notices).orderBy("doc_id").collect()] == ["MIT", "BSD-3-Clause", "ISC"]


def test_equal_rows_are_spread_over_the_packing_shards(spark):
    from logsentinel.llm import packing as P

    pieces = spark.range(3000).selectExpr("CAST(NULL AS LONG) AS doc_id", "0 AS piece", "0L AS start", "1L AS length", "0L AS ids_crc32")
    packed = P.pack(pieces, 2048, 3)
    sizes = sorted(r["count"] for r in packed.selectExpr("shiftright(sequence_id, 40) AS shard").groupBy("shard").count().collect())
    assert len(sizes) == 3 and sizes[0] > 800 and sum(sizes) == 3000


def test_averages_of_the_whole_text_are_scored_beside_the_windows(spark):
    from logsentinel.llm import toxicity as X

    rows = [(i, ("you vile stupid thing " if i % 3 == 0 else "a kind and sunny day ") * 6 + f"w{i % 11}") for i in range(300)]
    docs = spark.createDataFrame(rows + [(1000, None), (1001, "you vyle stupidd thing")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in X.score_toxicity(docs, labels).collect()}
    assert all((got[i]["average_score"] >= 0.5) == (i % 3 == 0) for i in range(300)) and got[1001]["average_score"] > 0.5 and 0 <= got[1000]["average_score"] <= 1
