import random

from tallyspark.llm import quotes

ROWS = [
    (1, 0, "user", "Where does the river end?\n\nAnd who lives there?"),
    (1, 1, "assistant", "Ann wrote:\n> Where does the river end?\n\nIt ends in the sea."),
    (1, 2, "user", "> > Where does the river end?\n> It ends in the sea.\n\nThank you for that."),
    (1, 3, "user", "An answer to the first.\n>  and WHO lives   there?\nNobody lives there now."),
    (1, 4, "user", "> never said by anyone at all\nNo original."),
    (2, 0, "user", ">It ends in the sea.\nQuoted from elsewhere."),
    (2, 0, "user", ">It ends in the sea.\nQuoted from elsewhere."),
    (3, 0, "user", None),
    (3, 1, "user", ""),
    (None, 4, "user", "> It ends in the sea.\nwithout conversation"),
    (0, 0, "user", "> It ends in the sea.\nquotes a later one"),
    (4, 0, "user", "ok"),
    (4, 1, "user", "> ok\nyes"),
]


def test_links(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "conv_id long, turn long, role string, text string, hash string").repartition(3)
    got = [r for r in quotes.link_quotes(df).collect()]
    at = {(r.conv_id, r.turn): r for r in got}
    parent = {k: (r.parent_conv, r.parent_turn) for k, r in at.items()}
    assert parent[1, 1] == (1, 0) and parent[1, 2] == (1, 1) and parent[1, 3] == (1, 0)
    assert parent[1, 4] == (None, None) and parent[2, 0] == (1, 1) and parent[0, 0] == (None, None) and parent[None, 4] == (None, None)
    assert parent[4, 1] == (4, 0)
    assert (at[2, 0].root_conv, at[2, 0].root_turn, at[2, 0].depth) == (1, 0, 2)
    assert at[1, 1].text == "It ends in the sea." and at[1, 2].text == "Thank you for that." and at[3, 0].text == ""
    assert at[1, 3].text == "An answer to the first.\nNobody lives there now."
    assert len(got) == len(ROWS)
    order = [(r.conv_id, r.turn) for r in got]
    assert order.index((1, 0)) < order.index((1, 1)) < order.index((1, 2)) < order.index((4, 0))
    assert quotes.link_quotes(df.where("false")).count() == 0


def test_long_chain(spark):
    rows = [(9, 0, "user", "message number zero of many")]
    rows += [(9, i, "user", f"> message number {i - 1 if i > 1 else 'zero'} of many\nmessage number {i} of many") for i in range(1, 70)]
    got = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [r.depth for r in got] == list(range(70)) and {r.root_turn for r in got} == {0}


def test_levels():
    found = quotes.passages(">> a\n> > b\n> c\nd\nJo schrieb:\n> e")
    assert found == [(2, ["a", "b"]), (1, ["c"]), (0, ["d"]), (1, ["e"])]


def test_replies_follow_unless_they_quote(spark):
    """Against brute force: random conversations, in which some messages quote an earlier one, two levels deep at times."""
    rnd = random.Random(8)
    rows, want = [], {}
    for conv in range(6):
        turns, own = sorted(rnd.sample(range(5000), 25)), {}
        for i, turn in enumerate(turns):
            own[turn] = f"message of {conv} at turn {turn} says this"
            parent = turns[i - 1] if i else None
            quoted = rnd.choice(turns[:i]) if i and rnd.random() < 0.5 else None
            if quoted is not None:
                parent = quoted
            deeper = want.get((conv, quoted), (None, 0))[0] if quoted is not None else None
            lines = ([f"> > {own[deeper[1]]}"] if deeper and rnd.random() < 0.5 else []) + ([f"> {own[quoted].upper()}"] if quoted is not None else [])
            rows.append((conv, turn, "user", "\n".join([*lines, own[turn]])))
            want[conv, turn] = ((conv, parent) if parent is not None else None, want[conv, parent][1] + 1 if parent is not None else 0)
    got = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3), follow=True).collect()
    assert {(r.conv_id, r.turn): ((r.parent_conv, r.parent_turn) if r.parent_conv is not None else None, r.depth) for r in got} == want
    place = {(r.conv_id, r.turn): i for i, r in enumerate(got)}
    assert all(place[p] < place[m] for m, (p, _) in want.items() if p)


def test_following_skips_nulls_and_repeats(spark):
    rows = [(1, 0, "a"), (1, 0, "a"), (1, 7, None), (1, 2000, ""), (None, 1, "x"), (1, None, "y")]
    got = quotes.link_quotes(spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string"), follow=True).collect()
    assert len(got) == len(rows)
    assert {(r.turn, r.parent_turn) for r in got if r.conv_id == 1 and r.turn is not None} == {(0, None), (7, 0), (2000, 7)}


def test_a_long_conversation_of_few_quotes(spark):
    """3,000 turns over three pieces: runs that begin in one piece and end in another."""
    rnd, own = random.Random(3), lambda i: f"message at turn {i} says this"
    quoted = {i: rnd.randrange(i) for i in rnd.sample(range(1, 3000), 12)} | {1023: 5, 1024: 1000, 2048: 2047}
    depth, rows = {0: 0}, [(1, 0, "user", own(0))]
    for i in range(1, 3000):
        depth[i] = depth[quoted.get(i, i - 1)] + 1
        rows.append((1, i, "user", (f"> {own(quoted[i])}\n" if i in quoted else "") + own(i)))
    got = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3), follow=True).collect()
    assert {r.turn: r.depth for r in got} == depth and {(r.root_conv, r.root_turn) for r in got} == {(1, 0)}
    assert all(r.parent_turn == quoted.get(r.turn, r.turn - 1) for r in got if r.turn)
