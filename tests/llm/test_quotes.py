import collections
import random

from millrace.llm import queries, quotes

SCHEMA = "conv_id long, turn long, role string, text string"


def test_passages_and_depths():
    text = "Hi,\n\nOn Monday, A wrote:\n> first\n> still first\n>> older\n>\n> again\n\nMine.\n"
    assert quotes.passages(text) == [(0, "Hi,"), (1, "first\nstill first"), (2, "older"), (1, "again"), (0, "Mine.")]
    assert quotes.passages("> > two\n>>two more\n| no quote") == [(2, "two\ntwo more"), (0, "| no quote")]
    assert quotes.passages("") == [] and quotes.passages(">\n>") == []


def test_links_find_the_answered_message(spark, small):
    c = spark.read.parquet(f"{small}/conversations.parquet")
    own = {(r.conv_id, r.turn): r.text for r in c.collect()}
    got = quotes.linked(quotes.as_mail(c)).collect()
    assert len(got) == len(own)
    for r in got:
        assert r.text == own[r.conv_id, r.turn] and r.n_linked == r.n_quotes
        want = None if r.turn == 0 else r.turn - 2 if r.turn % 3 == 0 else r.turn - 1
        if own.get((r.conv_id, want)) != own.get((r.conv_id, r.parent_turn)):
            raise AssertionError(r)
    for conv in {r.conv_id for r in got}:
        rows = sorted((r for r in got if r.conv_id == conv), key=lambda r: r.position)
        assert [r.position for r in rows] == list(range(len(rows)))
        seen = {}
        for r in rows:
            assert r.depth == (0 if r.parent_turn is None else seen[r.parent_turn] + 1)
            seen[r.turn] = r.depth


def test_reply_order_ties_and_other_conversations(spark):
    rows = [
        (1, 0, "a", "root words here"), (1, 1, "b", "> root words here\nfirst answer"), (1, 2, "c", "> Root, words HERE!\nsecond answer"),
        (1, 3, "a", "> first answer\n>> root words here\nto the first"), (1, 4, "b", "> nobody said that\nlost"), (1, 5, "d", "> second answer\n\n> to the first\n\n> to the first\nboth"),
        (2, 0, "x", "root words here"), (2, 1, "y", "> root words here\nown copy counts"), (3, 0, "z", "> second answer\nfrom elsewhere"), (3, 1, "z", "> from elsewhere\nno quote of oneself\n> no quote of oneself"),
    ]
    got = {(r.conv_id, r.turn): r for r in quotes.linked(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [t for _, t in sorted((got[1, t].position, t) for t in range(6))] == [0, 1, 3, 5, 2, 4]
    assert [got[1, t].depth for t in range(6)] == [0, 1, 1, 2, 0, 3]
    assert [got[1, t].parent_turn for t in range(6)] == [None, 0, 0, 1, None, 3]
    assert (got[1, 4].n_quotes, got[1, 4].n_linked) == (1, 0) and got[1, 3].n_linked == 2
    assert got[2, 1].parent_conv_id == 2 and (got[3, 0].parent_conv_id, got[3, 0].parent_turn, got[3, 0].depth) == (1, 2, 0)
    assert got[3, 1].parent_turn == 0 and got[1, 5].text == "both"


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "a", "> x\ny"), (None, 1, "a", "> x\ny"), (1, None, "a", "first"), (1, 0, "a", ""), (1, 0, "a", None), (1, 1, None, "> first\nyes"), (1, 1, None, "> first\nyes"), (1, 2, "a", "> " + "long " * 50_000), (1, 2, "b", ">" * 1000 + " deep")]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("id", "hash", "own", "mark", "place"):
        df = df.selectExpr("*", f"'clash' AS {name}")
    got = quotes.linked(df).collect()
    assert len(got) == 8
    assert [r.parent_turn for r in got if r.turn == 1 and r.conv_id == 1] == [None] and [r.n_linked for r in got if r.turn == 1 and r.conv_id == 1] == [1]
    assert all(r.position == 0 for r in got if r.conv_id is None)
    assert quotes.linked(spark.createDataFrame([], SCHEMA)).count() == 0


def by_hand(rows):
    """Links and order of messages (conv_id, turn, role, text), each compared with every other one."""
    parsed = []
    for c, t, role, text in sorted(set(rows)):
        found = quotes.passages(text)
        parsed.append((c, t, role, text, {h for d, p in found if d == 0 for h in quotes.paragraph_hashes(p)}, [(d, h) for d, p in found if d for h in quotes.paragraph_hashes(p)], "\n\n".join(p for d, p in found if d == 0)))
    out = {}
    for i, (c, t, _, _, _, asked, body) in enumerate(parsed):
        count, linked = collections.Counter(), 0
        for depth, h in asked:
            near = [j for j, m in enumerate(parsed) if m[0] == c and m[1] < t and h in m[4]]
            far = [j for j, m in enumerate(parsed) if m[0] != c and h in m[4]]
            j = max(near, key=lambda j: parsed[j][1]) if near else min(far, key=lambda j: parsed[j][:2]) if far else None
            if j is not None:
                linked += 1
                count[j] += depth == 1
        best = max(((n, parsed[j][1], parsed[j][0], j) for j, n in count.items() if n), default=None)
        out[i] = (c, t, body, best and parsed[best[3]][:2], len(asked), linked)
    order = {}
    for conv in {m[0] for m in parsed}:
        own = [i for i in out if out[i][0] == conv]
        place = {out[i][1]: i for i in own}

        def visit(i, depth):
            order[i] = (sum(out[k][0] == conv for k in order), depth)
            for k in own:
                if out[k][3] == (conv, out[i][1]) and out[k][1] > out[i][1]:
                    visit(k, depth + 1)

        for i in own:
            p = out[i][3]
            if p is None or p[0] != conv or p[1] not in place:
                visit(i, 0)
    return {(c, t): (*order[i], body, parent, n, linked) for i, (c, t, body, parent, n, linked) in out.items()}


def test_query_equals_linking_by_hand(spark, small):
    mail = [tuple(r) for r in quotes.as_mail(spark.read.parquet(f"{small}/conversations.parquet")).select("conv_id", "turn", "role", "text").collect()]
    want = by_hand(mail)
    got = queries.op4_quotation_linking(spark, small).collect()
    assert len(got) == len(want)
    for r in got:
        parent = None if r.parent_turn is None else (r.parent_conv_id, r.parent_turn)
        assert (r.position, r.depth, r.text, parent, r.n_quotes, r.n_linked) == want[r.conv_id, r.turn]


def test_random_threads_equal_linking_by_hand(spark):
    rnd = random.Random(3)
    rows, said = [], []
    for c in range(12):
        for t in range(rnd.randrange(1, 9)):
            own = " ".join(rnd.choice("alpha beta gamma delta".split()) for _ in range(rnd.randrange(1, 4)))
            quoted = [rnd.choice(said) for _ in range(rnd.randrange(3))] if said else []
            text = "\n\n".join(["> " + q if rnd.random() < 0.7 else ">> " + q for q in quoted] + [own])
            rows.append((c, t, "user", text))
            said.append(own if rnd.random() < 0.9 else "never said")
    want = by_hand(rows)
    for r in quotes.linked(spark.createDataFrame(rows, SCHEMA)).collect():
        parent = None if r.parent_turn is None else (r.parent_conv_id, r.parent_turn)
        assert (r.position, r.depth, r.text, r.n_quotes, r.n_linked) == (want[r.conv_id, r.turn][0:3] + want[r.conv_id, r.turn][4:]) and parent == want[r.conv_id, r.turn][3]
