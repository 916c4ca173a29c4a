"""Conversation repair, filter audit and token counts on small tables with every awkward row, against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from compare import open_duckdb
from pyspark.sql import functions as F

from hindcast.llm import conversation_repair as repair
from hindcast.llm import filter_audit, token_counts
from hindcast.llm.oracle import ORACLE

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
VISIBLE = re.compile(r"[^\x20\x09-\x0D]")
GRAMMAR = re.compile(r"(s?(ua)+)?")
TURNS = "conv_id long, turn long, role string, text string"


# --- 11 conversation repair ----------------------------------------------------------------------------------------


def every_repair(rows):
    """(cost, audit, repaired rows) of every sequence of edits with at most two inserts at a place, accepted or not."""
    def edits(i):
        for inserted in itertools.chain([()], [(r,) for r in ("user", "assistant")], itertools.permutations(("user", "assistant"))):
            head = (5 * len(inserted), "I" * len(inserted), tuple((r, "") for r in inserted))
            if i == len(rows):
                yield head
                continue
            role, text, must_go, cut = rows[i]
            options = [(2, "D", ())]
            if not must_go:
                options += [(5 * cut, "K", ((role, text),))]
                options += [(1 + 5 * cut, "R", ((r, text),)) for r in ("user", "assistant")]
            for cost, initial, kept in options:
                yield head[0] + cost, head[1] + initial, head[2] + kept

    for parts in itertools.product(*[list(edits(i)) for i in range(len(rows) + 1)]):
        yield sum(p[0] for p in parts), "".join(p[1] for p in parts), [r for p in parts for r in p[2]]


def cheapest(rows):
    accepted = (p for p in every_repair(rows) if GRAMMAR.fullmatch("".join(r[:1] or "-" for r, _ in p[2])))
    return min(accepted, key=lambda p: (p[0], p[1]))


def with_faults(rows):
    seen, out, counts = set(), [], Counter()
    for role, text in rows:
        fault = "blank" if not VISIBLE.search(text) else "duplicate" if (role, text) in seen else None
        if fault is None and not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text):
            fault = "truncated"
        seen.add((role, text))
        counts[fault] += 1
        out.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    return out, counts


def numbers(rows):
    initials = [repair._INITIALS.get(r[0][:1], 0) for r in rows]
    return initials, [r[2] * repair._MUST_GO + r[3] * repair._CUT for r in rows]


def test_search_finds_the_first_of_the_cheapest():
    rng = random.Random(3)
    for _ in range(60):
        rows = [(rng.choice(["system", "user", "assistant", "tool", ""]), "t.", rng.random() < 0.2, rng.random() < 0.2) for _ in range(rng.randint(0, 3))]
        rows = [(r, t, gone, cut and not gone) for r, t, gone, cut in rows]
        cost, audit, _ = cheapest(rows)
        for stretch in (1, 2, 64):
            found = repair.Repair(*numbers(rows), stretch)
            assert (found.cost, found.audit) == (cost, audit), rows


def by_steps(initials, flags):
    """The least (cost, edits) by dynamic programming over rows."""
    best = {0: (0, "")}

    def insert(best):
        for state in (0, 1, 3, 2):
            if state in best:
                to = repair._NEXT[state]
                path = (best[state][0] + 5, best[state][1] + "I")
                best[to] = min(best.get(to, path), path)
        return best

    for initial, flag in zip(initials, flags):
        after = {}
        for state, (cost, edits) in insert(best).items():
            tries = [(state, cost + 2, "D")]
            if not flag & repair._MUST_GO:
                more = 5 if flag & repair._CUT else 0
                tries.append((repair._NEXT[state], cost + 1 + more, "R"))
                if repair._KEPT[state][initial] is not None:
                    tries.append((repair._KEPT[state][initial], cost + more, "K"))
            for to, price, edit in tries:
                after[to] = min(after.get(to, (price, edits + edit)), (price, edits + edit))
        best = after
    best = insert(best)
    return min(best[s] for s in (0, 3) if s in best)


@pytest.mark.parametrize("rows", [30, 63, 64, 65, 400, 3000])
def test_long_conversations(rows):
    rng = random.Random(rows)
    for weights in ((1, 10, 10, 1), (0, 1, 1, 0), (1, 0, 5, 1)):
        initials = rng.choices(range(4), weights, k=rows)
        flags = rng.choices([0, 1, 2], (8, 1, 1), k=rows)
        found = repair.Repair(initials, flags)
        assert (found.cost, found.audit) == by_steps(initials, flags)


def applied(audit, rows):
    """The rows an audit leaves: from the first user on, roles take turns."""
    rows, out = iter(rows), []
    for edit in audit:
        role, text = next(rows) if edit != "I" else (None, "")
        turn = ("user", "assistant")[sum(r[:1] != "s" for r, _ in out) % 2]
        if edit != "D":
            out.append((role if edit == "K" else turn, text))
    return out


def expected_repairs(turns):
    groups = defaultdict(list)
    for conv, turn, role, text in turns:
        role, text = role if role is not None else " ", text if text is not None else " "
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        draw = zlib.crc32(name.encode()) % 20
        groups[conv] += []
        if draw == 0:
            continue
        role = "user" if draw == 4 else role
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        groups[conv] += [(turn, role, text)] * (2 if draw == 3 else 1)
    out = set()
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        marked, counts = with_faults([r[1:] for r in rows])
        cost, audit = by_steps(*numbers(marked))
        left = applied(audit, [r[1:] for r in rows])
        turns_seen = {r[0] for r in rows if r[0] is not None}
        gaps = max(turns_seen) - min(turns_seen) + 1 - len(turns_seen) if turns_seen else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
        illegal = sum(p not in ("su", "ua", "au") for p in pairs)
        out.add((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest))
    return out


def some_turns():
    rng = random.Random(11)
    texts = ["Yes.", "No!", "what", "", " \n", None, "Why? ", "a b.", "long words. " * 400]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
    rows = [(c, t, rng.choice(roles), rng.choice(texts)) for c in range(60) for t in rng.sample(range(9), rng.randint(1, 4))]
    rows += [(70, None, "user", "Hi."), (70, None, "assistant", "Ho."), (70, 3, None, None), (None, 1, "user", "x."), (None, None, "assistant", "y.")]
    rows += [(71, 1, "user", "Same."), (71, 1, "user", "Same."), (71, 1, "assistant", "Tie.")]
    # The drawn number of (c, 0) is 0 for some c, whose conversation then has no rows.
    return rows + [(c, 0, "user", "Gone.") for c in range(100, 160)]


def test_repairs_of_a_table(spark):
    turns = spark.createDataFrame(some_turns(), TURNS)
    for parts in (1, 5):
        found = repair.repaired(turns.repartition(parts).withColumn("audit", F.lit(1)).withColumn("_conv", F.lit(2)))
        assert {tuple(r) for r in found.collect()} == expected_repairs(some_turns())
    assert any(r[7] == "" and r[0] >= 100 for r in expected_repairs(some_turns()) if r[0])
    assert repair.repaired(turns.limit(0)).count() == 0


def test_statement_agrees_on_awkward_rows(spark, tmp_path):
    spark.createDataFrame(some_turns(), TURNS).coalesce(1).write.parquet(str(tmp_path / "c"))
    con = open_duckdb("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/c/*.parquet')")
    cursor = con.execute(ORACLE["op11_conversation_repair"])
    assert set(cursor.fetchall()) == expected_repairs(some_turns())


# --- 12 filter audit -----------------------------------------------------------------------------------------------


def failed_filters(text, doc, smallest):
    words = SPACED.findall(text)
    upper = sum("A" <= c <= "Z" for c in text)
    tests = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * upper > 10 * len(text), bool(re.search(r"[#$%&*|]", text)))
    copy = doc is not None and smallest[text] is not None and doc > smallest[text]
    return {k for k, t in zip("ABCDE", (*tests, copy)) if t}


def expected_audit(docs, labels):
    smallest = defaultdict(lambda: None)
    for doc, text, _ in docs:
        if doc is not None:
            old = smallest[text or ""]
            smallest[text or ""] = doc if old is None else min(old, doc)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    rows = [(lang or "", doc, failed_filters(text or "", doc, smallest)) for doc, text, lang in docs]
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            for step, letter in enumerate(order, 1):
                gone = [r for r in left if letter in r[2]]
                failing = [r for r in rows if r[0] == part and letter in r[2]]
                left = [r for r in left if letter not in r[2]]
                shapley[part, letter] += len(gone)
                out[part, order, step] = [
                    len(left), len(gone), len(failing) - len(gone), sum(r[2] == {letter} for r in failing),
                    sum(r[1] in good for r in gone), sum(r[1] in toxic for r in gone),
                ]
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit(spark):
    rng = random.Random(5)
    texts = ["short Text", " ".join(f"w{i}" for i in range(120)), "one two " * 80, "LOUD WORDS " * 60, "cost: $5 | " + " ".join(f"v{i}" for i in range(200)), None, ""]
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(90)]
    docs += [docs[0], docs[0], (docs[3][0], docs[3][1], "fr"), (None, texts[1], "en"), (None, "never elsewhere", "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 90, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (500, 1, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(4)
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    clashing = frame.withColumns({"part": F.lit(1), "id": F.lit(2), "filter": F.lit("A"), "before": F.lit(3), "words": F.lit(4)})
    found = {tuple(r) for r in filter_audit.audited(clashing, marked.withColumn("id", F.lit(0))).collect()}
    assert found == expected_audit(docs, labels)
    none = filter_audit.audited(frame, marked.limit(0)).collect()
    assert len(none) == len(found) and not any(r["good_lost"] or r["toxic_lost"] for r in none)
    assert filter_audit.audited(frame.limit(0), marked).count() == 0


# --- 13 token counts -----------------------------------------------------------------------------------------------

tokenizers = pytest.importorskip("tokenizers")
PATH = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def odd_texts():
    rng = random.Random(9)
    pieces = ["the", " the", "  ", "\n\n", "\t", "don't", "'LL", "'s", "日本語", "né", "é", " ", " ", "1234", "½", "𝟜", "😀", "<|endoftext|>", "<|endoftext", "|>", "_x", "--", "՘", "꟝", "\U0003fc3f", "​", "\x00"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    return [*texts, None, "", " ", "  \n ", "a" * 5000, " " * 5000, "one two  three\n" * 2000, "x<|endoftext|><|endoftext|>"]



def test_token_counts_are_the_librarys(spark):
    texts = odd_texts()
    library = tokenizers.Tokenizer.from_file(PATH)
    expected = Counter((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in enumerate(texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for keep in (1, 50, token_counts.FREQUENT):
        clashing = docs.withColumn("n_tokens", F.lit("mine")).withColumn("piece", F.lit(1))
        assert Counter(tuple(r) for r in token_counts.counted(clashing, PATH, keep=keep).collect()) == expected
    assert token_counts.counted(docs.limit(0), PATH).count() == 0
    assert token_counts.frequent_pieces(docs.limit(0), PATH) == {}


def test_small_blocks_and_small_caches_count_alike():
    library = tokenizers.Tokenizer.from_file(PATH)
    for cache, block in ((1, 1 << 18), (40, 7), (1 << 20, 1)):
        counter = token_counts.Counter(PATH, {"the": 1, " the": 1}, cache, block)
        for text in odd_texts():
            assert counter.count(text or "") == len(library.encode(text or "", add_special_tokens=False).ids)


def test_each_missed_piece_is_encoded_once():
    counter = token_counts.Counter(PATH, {" the": 1})
    counter.count(" the zebras the zebras")
    asked = counter.asked
    counter.count(" zebras the zebras")
    assert counter.asked == asked


def test_pattern_cuts_like_the_library_below_the_later_characters():
    library = tokenizers.Tokenizer.from_file(PATH).pre_tokenizer
    counter = token_counts.Counter(PATH, {})
    for code in range(ord(token_counts.LATER)):
        text = f"a{chr(code)}1{chr(code)}! {chr(code)}{chr(code)} b"
        assert counter.pieces.findall(text) == [text[a:b] for _, (a, b) in library.pre_tokenize_str(text)], hex(code)


def test_other_vocabularies_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        token_counts.special_strings(public_tokenizers.path("word_bpe_49k.json"))
