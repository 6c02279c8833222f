"""Conversation repair, SentencePiece chunks and the Merkle manifest against brute force."""

import hashlib
import itertools
import os
import random
import zlib

import duckdb
import pytest

from tidemark.llm import merkle, pieces, queries, repair

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
TURNS = "conv_id long, turn long, role string, text string, fault string, seen int, g int"
DOCS = "doc_id long, source string, lang string, n_chars long, text string, g int, idx int, node string, block int, way string"


def same_as_sql(frame, sql, folder):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        path = f"{folder}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    names = sorted(frame.columns)
    rows = sorted(tuple(str(r[n]) for n in names) for r in frame.collect())
    assert rows == sorted(tuple(map(str, r)) for r in c.sql(f"select {', '.join(names)} from ({sql})").fetchall())
    return rows


@needs_data
@pytest.mark.parametrize("name", ["op11_conversation_repair", "op13_merkle_manifest"])
def test_query_equals_sql(spark, name):
    assert same_as_sql(queries.QUERIES[name](spark, SMALL), queries.SQL[name], SMALL)


def cheapest(rows):
    """The least (cost, audit, repaired) by trying all edits of a short conversation, at most two inserted turns in a row."""
    seen, best = set(), None
    options = []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        ways = [("D", 4, None)]
        if bare and (role, text) not in seen:
            more = 0 if bare[-1] in ".!?" else 3
            ways += [("K", more, (role, text))] + [("R", 3 + more, (r, text)) for r in ("user", "assistant")]
        seen.add((role, text))
        options.append(ways)
    inserts = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    for chosen in itertools.product(*options):
        # each place before, between and behind the rows may take inserted turns
        for added in itertools.product(inserts, repeat=len(rows) + 1):
            cost = sum(w[1] for w in chosen) + 3 * sum(map(len, added))
            if best and cost > best[0]:
                continue
            turns, audit = [], ""
            for i in range(len(rows) + 1):
                turns += [(r, "") for r in added[i]]
                audit += "I" * len(added[i])
                if i < len(rows):
                    audit += chosen[i][0]
                    turns += [chosen[i][2]] if chosen[i][2] else []
            letters = "".join(r[:1] for r, _ in turns)
            bare = letters[1:] if letters.startswith("s") else letters
            if letters and (len(bare) == 0 or bare != "ua" * (len(bare) // 2)):
                continue
            told = (cost, audit, "\n".join(f"{r}:{t}" for r, t in turns))
            if best is None or told[:2] < best[:2]:
                best = told
    return best


def test_repair_equals_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 4)):
            rows.append((c, rng.choice((t, t, 1, None)), rng.choice(("user", "assistant", "system", "tool", "umpire", None)), rng.choice(("Hello.", "Why?", "cut off", "", " \n", None, "Ok! \t"))))
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], TURNS)
    told = {r["conv_id"]: r for r in repair.plan_repairs(frame).collect()}
    for c in range(60):
        own = sorted(((-1 if t is None else t), r or " ", " " if x is None else x) for i, t, r, x in rows if i == c)
        cost, audit, text = cheapest([o[1:] for o in own])
        got = told[c]
        assert (got["cost"], got["audit"], got["repaired_sha256"]) == (cost, audit, hashlib.sha256(text.encode()).hexdigest()), own
        turns = {t for i, t, *_ in rows if i == c and t is not None}
        assert got["gaps"] == (max(turns) - min(turns) + 1 - len(turns) if turns else 0)
    # applying the plans gives the turns that were digested
    by = {}
    for r in sorted(repair.repaired_turns(frame, repair.plan_repairs(frame)).collect(), key=lambda r: r["turn"]):
        by.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert all(told[c]["repaired_sha256"] == hashlib.sha256("\n".join(by.get(c, [])).encode()).hexdigest() for c in range(60))


def test_damage_follows_the_hash_of_each_row(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(40) for t in range(5)] + [(None, None, None, None), (None, 7, "user", "a.")]
    got = repair.damage(spark.createDataFrame([(*r, "x", 1, 2) for r in rows], TURNS)).collect()
    for c, t, role, text in rows:
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        own = [(r["role"], r["text"], r["gone"]) for r in got if r["conv_id"] == c and r["turn"] == t]
        role, text = role or " ", text or " "
        want = {0: [(role, "", True)], 1: [(role, "", False)], 2: [(role, "One Two Three", False)], 3: [(role, text, False)] * 2, 4: [("user", text, False)]}.get(d, [(role, text, False)])
        assert own == want or c is None


def test_repair_edge_cases(spark, tmp_path):
    none = repair.plan_repairs(spark.createDataFrame([], TURNS))
    assert none.collect() == [] and none.columns == repair.NAMES
    gone = spark.createDataFrame([(1, 0, "user", "a.", True), (None, 1, "user", "b.", False)], "conv_id long, turn long, role string, text string, gone boolean")
    told = {r["conv_id"]: r for r in repair.plan_repairs(gone).collect()}
    assert tuple(told[1])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    # a lone user turn is deleted or answered: to answer it is cheaper
    assert (told[None]["cost"], told[None]["audit"]) == (3, "KI")
    # a conversation far longer than what survivors hold, every turn right, and a very long text
    long = [(5, i, ("user", "assistant")[i % 2], f"turn {i}.") for i in range(3000)] + [(6, 0, "user", "x" * 300_000 + "."), (6, 1, "assistant", "y" * 300_000)]
    got = {r["conv_id"]: r for r in repair.plan_repairs(spark.createDataFrame(long, "conv_id long, turn long, role string, text string")).collect()}
    assert got[5]["audit"] == "K" * 3000 and got[5]["cost"] == 0 and got[6]["audit"] == "KK" and got[6]["cost"] == 3
    assert got[5]["repaired_sha256"] == hashlib.sha256("\n".join(f"{r}:{t}" for _, _, r, t in long[:3000]).encode()).hexdigest()
    # nulls, ties and repeated rows as the SQL has them
    rows = [(1, 1, "user", "a."), (1, 1, "user", "a."), (1, None, "system", "s."), (None, None, None, None), (None, 3, "assistant", "b"), (2, 0, "tool", " "), (2, 0, "user", "c?"), (3, 2, "assistant", "d!"), (3, 2, "user", "e.")]
    rows += [(c, t, random.Random(c * 9 + t).choice(("user", "assistant", "system")), random.Random(c + t).choice(("q.", "q", "", "w!"))) for c in range(10, 90) for t in range(6)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(1, "a", "b", 1, "c")], "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    same_as_sql(queries.op11_conversation_repair(spark, str(tmp_path)), queries.SQL["op11_conversation_repair"], str(tmp_path))


HARD = [
    None, "", " ", "  ", "   ", "a", " a", "a ", "a  b", " a   b  ", "a\nb", "a \nb", "a\n b", "\na", " \n \n", "\n\n", "▁", "a▁b", "▁▁ a", "é ﬁ　日本語 ​", "\0a\tb\rc", "<s> </s><unk>",
    "<0x0A>", "�", "é \U0001f600\U0001f468‍\U0001f469", "x" * 50_000, "word " * 20_000, " " * 3000, "\n" * 3000, "The same. The same. The same.",
]


def library_digest(model, text):
    ids = [*model.encode(text or ""), model.eos_id()]
    return len(ids), " ".join(map(str, ids)), model.decode(ids)


@pytest.fixture(scope="module")
def model():
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())


def test_chunks_give_the_librarys_ids(model):
    rng = random.Random(3)
    own = pieces.segmenter(pieces.model_path())
    letters = ["a", "b", "th", "ing", " ", " ", "  ", "\n", "▁", "é", "日", "́", ".", "1", "\t", "\U0001f600", "<s>", " ", " "]
    texts = [t for t in HARD if t] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 25))) for _ in range(20_000)]
    for t in texts:
        assert own.by_chunks(t) == model.encode(t), t
        assert pieces.joined(pieces.chunks(t)) == t.replace("▁", " ") == model.decode(model.encode(t))


def test_pieces_equal_the_library_in_small_blocks(spark, model, tmp_path):
    rows = [(i, t, "g", 1, "c") for i, t in enumerate(HARD)] + [(None, "no id here", "g", 1, "c"), (3, "the id again", "g", 1, "c"), (3, "the id again", "g", 1, "c")]
    spark.createDataFrame(rows, "doc_id long, text string, ids string, block int, chunk string").repartition(3).write.parquet(f"{tmp_path}/d")
    table = spark.read.parquet(f"{tmp_path}/d")
    for block in (50, 1 << 25):
        got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids"], r["decoded"]) for r in pieces.encode(table, block_chars=block).collect())
        assert got == sorted((str(i), *library_digest(model, t)) for i, t, *_ in rows)
    none = pieces.encode(table.limit(0))
    assert none.collect() == [] and none.columns == ["doc_id", "n_tokens", "ids", "decoded"]


def test_each_chunk_is_segmented_once(spark, tmp_path):
    spark.createDataFrame([(i, f"the word {i % 3} and the word") for i in range(200)], "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/d")
    named = pieces.distinct_chunks(spark.read.parquet(f"{tmp_path}/d"), 8, 500)
    listed = [(r["block"], r["bucket"], c) for r in named.collect() for c in r["chunks"].split(pieces.MARK)]
    assert len(listed) == len(set(listed)) == len({(b, c) for b, _, c in listed}) and len({b for b, *_ in listed}) > 4
    assert len({c for *_, c in listed}) == 6 == len({(k, c) for _, k, c in listed})
    told = pieces.segment_chunks(named, pieces.model_path()).collect()
    assert sum(len(r["ids"].split("\n")) for r in told) == len(listed)
    assert len({pair for r in told for pair in zip(r["chunks"].split(pieces.MARK), r["ids"].split("\n"))}) == 6


@needs_data
def test_op12_equals_the_library(spark, model):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op12_sentencepiece(spark, SMALL).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect():
        n, ids, text = library_digest(model, r["text"])
        assert got[r["doc_id"]] == (n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def brute_manifest(rows):
    h = lambda *p: hashlib.sha256("".join(p).encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, s, g, n, t: h(*map(field, (i, s, g, n, t)))
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)

    def reduce(nodes):
        """The last node, and each one's way: (siblings before or behind, level by level)."""
        ways, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, p in enumerate(at):
                run = nodes[p // 2 * 2 : p // 2 * 2 + 2]
                ways[i].append((run[: p % 2], run[p % 2 + 1 :]))
            at = [p // 2 for p in at]
            nodes = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        return nodes[0], ways

    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: (own := sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r))), *reduce([leaf(*r) for r in own])) for g in order}
    root, over = reduce([trees[g][1] for g in order])
    told = []
    for g, above in zip(order, over):
        for row, way in zip(trees[g][0], trees[g][2]):
            i, s, _, n, t = row
            node = leaf(*row) if n is None or i is None or zlib.crc32(str(i).encode()) % 7 else leaf(i, s, g, n + 1, t)
            for a, b in way + above:
                node = h(*a, node, *b)
            told.append((i, g, leaf(*row), trees[g][1], root, h(*(x for a, b in way + above for x in a + b)), node, node == root))
    return sorted(map(str, told))


def test_manifest_equals_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(("web", None)), rng.choice(("en", "de", "fr", None, "é", "Z", "")), rng.choice((None, i)), rng.choice(("text é", None, "", "x" * 5000))) for i in range(300)]
    rows += [(None, None, None, None, None)] * 2 + [(7, "a", "en", 1, "same")] * 40 + [(7, "a", "en", 1, "other"), (50, "a", "only", 3, "alone")]
    rows += [(i, "s", f"language {i}", 5, "t") for i in range(1000, 1060)]
    frame = spark.createDataFrame([(*r, 1, 2, "n", 3, "w") for r in rows], DOCS)
    want = brute_manifest(rows)
    # one round; several rounds below languages; further rounds among the subroots
    for levels, top in ((10, 4096), (2, 100), (1, 8), (3, 1)):
        assert sorted(str(tuple(r)) for r in merkle.manifest(frame, levels, top).collect()) == want, (levels, top)
    none = merkle.manifest(frame.limit(0))
    assert none.collect() == [] and none.columns[0] == "doc_id"
    one = [(3, None, None, None, None, 1, 2, "n", 3, "w")]
    assert sorted(str(tuple(r)) for r in merkle.manifest(spark.createDataFrame(one, DOCS)).collect()) == brute_manifest([one[0][:5]])
