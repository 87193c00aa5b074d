"""Decontamination, repair and spelling: plain loops over all rows, and odd rows."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from notewell.llm import queries, repair, spelling, winnowing
from notewell.llm.common import prepare, scratch

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def ready(spark):
    prepare(spark)


# --- winnowing

def plain_contamination(docs, items):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    windows = defaultdict(set)
    for key, text in items:
        w = words(text)
        for i in range(max(0, len(w) - 10) + 1 if w else 0):
            windows[tuple(w[i:i + 10])].add("" if key is None else str(key))
    sizes = {len(x) for x in windows}
    found = []
    for key, text in docs:
        w, hit, met = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit.update(range(i, i + n))
                    met |= windows[tuple(w[i:i + n])]
        found.append((key, len(w), len(hit), len(met), sorted(met)))
    return sorted(found, key=repr)


def odd_benchmark():
    run = [f"w{i}" for i in range(40)]
    said = lambda a, b: " ".join(run[a:b])
    items = [(1, said(0, 25)), (2, said(20, 30)), (2, "Alone"), (3, "two words"), (None, "Überfluß x 9"), (4, None), (5, "..."), (1, said(0, 25)), (10, "a a a a a a a a a a a a")]
    docs = [
        (1, "Before " + said(0, 25) + " after"), (2, said(0, 9) + " x " + said(10, 20)), (3, said(1, 11)), (4, None), (5, ""), (6, "--- \n"), (7, "ALONE, two-words."), (7, "ALONE, two-words."),
        (None, "überfluß X 9! überfluß"), (8, "Überfluß x 9"), (9, "a " * 11), (9, "a " * 9), (11, said(15, 40)), (12, "z" * 5_000 + " " + said(3, 14) + " " + "z" * 70)]
    return docs, items


def test_contamination_equals_plain_loops(spark):
    docs, items = odd_benchmark()
    got = winnowing.contamination(spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, hash string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_contamination(docs, items)


def test_contamination_of_empty_tables(spark):
    docs, items = odd_benchmark()
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert winnowing.contamination(docs.limit(0), items).count() == 0
    got = winnowing.contamination(docs, items.limit(0)).collect()
    assert len(got) == docs.count() and not any(r.n_hit or r.n_items or r["items"] for r in got)


def test_words_of_long_texts(monkeypatch):
    """Pieces are cut between words only, so a long text has the words of the whole."""
    text = ("x" * 300 + " ab, c9 é" * 40 + "-") * 30
    whole = next(winnowing.words_of([text]))[1]
    monkeypatch.setattr(winnowing, "AT_ONCE", 64)
    parts = list(winnowing.words_of(["p q", text, "", "r"]))
    assert [first for first, _, _ in parts] == [0, 1, 2] and [list(c) for _, _, c in parts] == [[2], [len(whole)], [0, 1]]
    assert (parts[1][1] == whole).all() and len(whole) == len(re.findall(r"[0-9a-z\x80-\U0010ffff]+", text))
    assert len(set(whole.tolist())) == len(set(re.findall(r"[0-9a-z\x80-\U0010ffff]+", text)))


def test_hashes_tell_anagrams_apart():
    words = ["".join(p) for n in range(1, 7) for p in itertools.product("ab9", repeat=n)]
    h = winnowing.hashes_of(" ".join(words).encode())[0]
    assert len(set(h.tolist())) == len(words)


# --- repair

def plain_repair(roles, faults):
    """All edits of a short conversation, by dynamic programming over (cost, audit) of prefixes."""
    best = {0: (0, "")}

    def inserted(items):
        items = dict(items)
        for _ in range(3):
            for p, (c, a) in list(items.items()):
                for q in {repair.NEXT[p][x] for x in "ua" if x in repair.NEXT[p]}:
                    items[q] = min(items.get(q, (10**9, "")), (c + 3, a + "I"))
        return items

    for role, fault in zip(roles, faults):
        after = {}
        for p, (c, a) in inserted(best).items():
            moves = [(4, "D", p)]
            if fault in ("", "t"):
                extra = 3 * (fault == "t")
                moves += [(extra, "K", repair.NEXT[p][role[:1]])] if role[:1] in repair.NEXT[p] else []
                moves += [(3 + extra, "R", repair.NEXT[p][x]) for x in "ua" if x in repair.NEXT[p]]
            for more, letter, q in moves:
                after[q] = min(after.get(q, (10**9, "")), (c + more, a + letter))
        best = after
    return min(v for q, v in inserted(best).items() if q in (0, 3))


def plain_row(conv, rows):
    """The whole result of one conversation from its damaged rows (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    faults, seen = [], set()
    for _, role, text in rows:
        stripped = text.rstrip(repair.SPACE)
        faults.append("b" if not stripped else "d" if (role, text) in seen else "" if stripped[-1] in ".!?" else "t")
        seen.add((role, text))
    cost, audit = plain_repair([r[1] for r in rows], faults)
    kept, odd, i = [], sum(x != "D" for x in audit) % 2, 0
    for letter in audit:
        role = "user" if (len(kept) - odd) % 2 == 0 else "assistant"
        if letter == "I":
            kept.append(f"{role}:")
        elif letter != "D":
            kept.append(f"{rows[i][1] if letter == 'K' else role}:{rows[i][2]}")
        i += letter != "I"
    turns = {r[0] for r in rows if r[0] is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit,
            hashlib.sha256("\n".join(kept).encode()).hexdigest())


def plain_damage(rows):
    said = lambda x: " " if x is None else str(x)
    found = []
    for conv, turn, role, text in rows:
        h, role, text = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20, said(role), said(text)
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        found += [(conv, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return found


def odd_conversations():
    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", "Why?"), (1, 2, "assistant", "So."), (2, 0, "assistant", "So."), (2, 2, "user", "cut"), (None, None, "user", "a."), (None, 1, None, None),
            (None, 1, "assistant", "b!"), (3, None, "tool", ""), (4, 7, "user", " \t"), (5, 1, "user", "x."), (5, 1, "user", "x."), (5, 3, "assistant", "y"), (6, 0, "", "z."), (7, 0, "system", "alone."),
            (8, 0, "user", "w " * 50_000 + "."), (8, 1, "assistant", "Ä?\n")]
    rows += [(9, t, ("user", "assistant", "system", "user")[t * t % 4], ("Yes.", "no", "", "Why?", f"row {t}.")[t * 7 % 5]) for t in range(700)]
    return rows + [(10 + c, t, "user" if t % 2 == 0 else "assistant", f"{c} {t}.") for c in range(60) for t in range(4)]


def repaired(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, position string")
    return sorted((tuple(r) for r in repair.repair(repair.damage(df), df).collect()), key=repr)


def test_repair_equals_plain_loops(spark):
    rows, by = odd_conversations(), defaultdict(list)
    for conv, *rest in plain_damage(rows):
        by[conv].append(tuple(rest))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want = [plain_row(c, by[c]) if by[c] else (c, *nothing) for c in {r[0] for r in rows}]
    assert repaired(spark, rows) == sorted(want, key=repr)
    assert repaired(spark, []) == []


def test_repair_of_a_conversation_in_many_parts(spark):
    rows = [r for r in odd_conversations() if r[0] in (8, 9, 10)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    numbered = repair.number(df, scratch(spark, "test"))
    faults = repair.find_faults(numbered).checkpoint()
    whole = repair.derive(faults, 4096)
    parts = repair.derive(faults, 8, 3)
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, whole.collect())) and whole.count() == 3


def test_repaired_rows_alternate(spark):
    df = spark.createDataFrame(odd_conversations(), "conv_id long, turn long, role string, text string")
    numbered = repair.number(df, scratch(spark, "test"))
    rows = repair.repaired_rows(numbered, repair.derive(repair.find_faults(numbered))).collect()
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.conv, r.nth)):
        by[r.conv].append(r)
    assert all(re.fullmatch("s?(ua)+", "".join(r.role[0] for r in c)) and [r.nth for r in c] == list(range(len(c))) for c in by.values())
    assert all(r.text == "" and r.turn is None for r in rows if r.edit == "I")


# --- spelling

def plain_variants(docs):
    n = Counter()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for key, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(low)
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += len(w) >= 6
    n = {w: k for w, k in n.items() if k >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    by = {w: sorted((x for x in n if near(w, x)), key=lambda x: (-n[x], x)) for w in n}
    form = {w: x[0] if x and n[x[0]] >= 5 * n[w] else None for w, x in by.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n[w], len(by[w]), n[form[w]] if form[w] else None) for w in n), key=repr)


def odd_words():
    said = [("letters", 2), ("letter", 1), ("lettérs", 1), ("lettters", 1), ("Letteers", 12), ("aaaaaa", 1), ("aaaaaaa", 7), ("ÀÉabcd", 1), ("àéabcd", 1), ("abcde", 9), ("w" * 3000, 1), ("w" * 2999, 1)]
    docs = [(k, " ".join([w] * n)) for k in range(40) for w, n in said]
    return docs + [(None, "letters letters3letters_"), (1, None), (2, ""), (3, "letters"), (3, "letters")]


def test_variants_equal_plain_loops(spark):
    docs = odd_words()
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, word string")
    want = plain_variants(docs)
    assert sorted((tuple(r) for r in spelling.variants(df).collect()), key=repr) == want and any(w[1] for w in want)
    assert spelling.variants(df.limit(0)).count() == 0


def test_filters_in_many_passes(spark):
    """Filters larger than what is broadcast at once are probed part by part."""
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    vocab = spelling.vocabulary(df)
    whole = {tuple(r) for r in spelling.near_pairs(vocab).collect()}
    small = spelling.near_pairs(vocab, blocks_each=64, at_once=2048)
    assert len(whole) > 10 and {tuple(r) for r in small.collect()} == whole and small.count() == len(whole)


@pytest.mark.parametrize("name", ["op11_decontaminate", "op12_repair", "op13_spelling"])
def test_queries_equal_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    want = c.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SF).select(*want.columns)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want.fetchall(), key=repr)
