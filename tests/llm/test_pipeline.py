"""The pipeline and its stages, and quotation links."""

import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import quote_links


def brute_near(texts, k):
    """(size, component) of each text by comparing all pairs."""
    sets = {d: {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for d, w in ((d, t.lower().split()) for d, t in texts.items())}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[:i]:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in names}


def corpus(spark, tmp_path):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    line = "This line stands in very many documents."
    leak = " ".join(word() for _ in range(30))
    rows, labels, kinds = [], [], {}
    for i in range(240):
        words = [word() for _ in range(rng.randint(40, 90))]
        kind = "plain"
        if i % 6 == 0:
            kind = "toxic"
            words[3:3] = ["idiot", "moron"]
        elif i % 10 == 1:
            kind, words = "copy", list(rows[i - 1][1].split()) if kinds[i - 1] == "plain" else words
            words[1] = word()
        elif i % 12 == 3:
            kind, words = "leak", words[:10] + leak.split() + words[10:]
        body = " ".join(words)
        if i % 5 == 0:
            body += "\n" + line
        rows.append((i, body, "en", "s", len(body)))
        kinds[i] = kind
        labels.append((i, 1, int(kind == "toxic")))
    where = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where, dict((r[0], r[1]) for r in rows), kinds


def test_pipeline_keeps_what_brute_force_keeps(spark, tmp_path):
    where, texts, kinds = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{where}/documents.parquet")
    # Stage by stage, each judged on its own input.
    left = {d: t for d, t in texts.items() if kinds[d] != "toxic"}
    out = corpus_pipeline.drop_toxic(spark, docs, where)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == set(left)
    line = "This line stands in very many documents."
    holders = [d for d, t in left.items() if t.endswith("\n" + line)]
    left = {d: t[: -len(line) - 1] if d in holders and d != max(holders) else t for d, t in left.items()}
    out = corpus_pipeline.drop_repeated_lines(spark, out, where)
    assert {r.doc_id: r.text for r in out.collect()} == left and out.columns == docs.columns
    assert out.where(F.length("text") != F.col("n_chars")).count() == 0
    groups = brute_near(left, 5)
    left = {d: t for d, t in left.items() if groups[d][1] == d}
    out = corpus_pipeline.drop_near_copies(spark, out, where)
    assert {r.doc_id for r in out.collect()} == set(left) and len(left) < 200
    left = {d: t for d, t in left.items() if kinds[d] != "leak"}
    out = corpus_pipeline.drop_benchmark_leaks(spark, out, where)
    assert {r.doc_id for r in out.collect()} == set(left)
    pieces = corpus_pipeline.run(spark, where)
    assert {r.doc_id for r in pieces.collect()} == set(left)
    totals = pieces.groupBy("doc_id").agg(F.sum("length").alias("a"), F.max("doc_tokens").alias("b"))
    assert totals.where("a <> b").count() == 0


def test_stages_on_empty_documents(spark, tmp_path):
    where, _, _ = corpus(spark, tmp_path)
    none = spark.read.parquet(f"{where}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, where).count() == 0


CHAT = [
    (1, 0, "user", "Hello there my friends.\nThe second line is here.\n\nAnother paragraph of words."),
    (1, 1, "assistant", "> Hello there my friends.\n> The second line is here.\n\nI agree with this fully."),
    (1, 2, "user", "Something different entirely now."),
    (1, 3, "user", "> > Hello there my friends.\n> > The second line is here.\n>\n> I agree with this fully.\nNested reply text goes on."),
    (1, 4, "assistant", "just continuing the branch"),
    (1, 5, "user", "> Something different entirely, NOW!\nback to two"),
    (1, 6, "user", "> nested REPLY text goes on.\nthird level branch here"),
    (1, 7, "user", "> not to be found anywhere\nno link"),
    (2, 0, "user", None),
    (2, 1, "user", "> Hello there my friends."),
    (2, 1, "user", "a row of the same turn"),
    (None, 1, "x", "> Hello there my friends."),
    (3, None, None, "text"),
]


def test_quotes_are_linked_and_ordered(spark):
    frame = spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string").withColumn("branch_depth", F.lit("clash")).repartition(3)
    for block in (1024, 2, 1):
        got = {(r.conv_id, r.turn, r.text): (r.n_quotes, r.n_linked, r.parent_turn, r.branch_depth, r.reply_order) for r in quote_links.reply_order(frame, block=block).collect()}
        assert len(got) == len(CHAT)
        own = {k[1]: v for k, v in got.items() if k[0] == 1}
        assert own == {
            0: (0, 0, None, 0, 1), 1: (1, 1, 0, 0, 2), 2: (0, 0, 1, 0, 7), 3: (2, 2, 1, 1, 3), 4: (0, 0, 3, 1, 6),
            5: (1, 1, 2, 1, 8), 6: (1, 1, 3, 2, 4), 7: (1, 0, 6, 2, 5),
        }
        assert got[(2, 1, "")] == (1, 0, 0, 0, 2) and got[(None, 1, "")] == (1, 0, None, 0, None)


def brute_order(rows):
    """(order, depth) of messages (conv, turn, answers) by walking the tree; answers opens a branch."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((t, a) for c, t, a in rows if c == conv)
        branch, members, opens = None, {None: []}, {}
        for turn, answers in own:
            if answers is not None:
                branch = turn
                members[branch] = []
                opens.setdefault(answers, []).append(turn)
            members[branch].append(turn)
        todo, place = [(None, 0, 0)], 0
        while todo:
            b, k, depth = todo.pop()
            if k == len(members[b]):
                continue
            turn, place = members[b][k], place + 1
            out[conv, turn] = (place, depth)
            todo.append((b, k + 1, depth))
            todo += [(child, 0, depth + 1) for child in sorted(opens.get(turn, []), reverse=True)]
    return out


def ordered(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, answers long").repartition(3)
    seen, branch, chain = {}, {}, []
    for conv, turn, answers in sorted(rows, key=lambda r: r[:2]):
        branch[conv] = turn if answers is not None else branch.get(conv, quote_links.ROOT)
        chain.append((conv, turn, branch[conv]))
    frame = frame.join(spark.createDataFrame(chain, "conv_id long, turn long, branch long"), ["conv_id", "turn"])
    return {(r.conv_id, r.turn): (r.reply_order, r.branch_depth) for r in quote_links.branch_order(frame).collect()}


def test_branches_are_walked_in_order(spark):
    """Random trees, several answers to one message, and branches that end together."""
    rng = random.Random(41)
    rows = []
    for conv in range(12):
        turns = sorted(rng.sample(range(200), rng.randint(2, 40)))
        rows += [(conv, t, rng.choice(turns[: max(1, i - 1)][-rng.choice([1, 3, 40]) :]) if i > 1 and rng.random() < 0.5 else None) for i, t in enumerate(turns)]
    assert ordered(spark, rows) == brute_order(rows)


def test_long_chain_of_branches_takes_rows_in_proportion(spark):
    """Each message answers the one two before: branches nest half as deep as the conversation is long."""
    rows = [(1, t, t - 2 if t > 1 else None) for t in range(6000)]
    got = ordered(spark, rows)
    assert got == brute_order(rows) and max(d for _, d in got.values()) > 2900


def brute_links(rows, min_chars=8):
    """Originals by definition: for each quoted passage (or one of its lines) the latest earlier message that holds it."""
    import re

    norm = lambda s: re.sub(r"[\s!-/:-@\[-`{-~]+", " ", s.lower()).strip()

    def passages(text):
        out, last = [], None
        for line in (text or "").split("\n"):
            m = re.match(r"[ \t]*((?:>[ \t]*)+)", line)
            level, body = (m[1].count(">"), line[m.end() :]) if m else (0, line)
            if not body.strip():
                last = None
                continue
            if last == level:
                out[-1][1].append(body)
            else:
                out.append((level, [body]))
            last = level
        return out

    held = {}
    for conv, turn, _, text in rows:
        for level, body in passages(text):
            if level == 0:
                for unit in ["\n".join(body), *body]:
                    held.setdefault((conv, norm(unit)), set()).add(turn)
    found = set()
    for conv, turn, _, text in rows:
        for level, body in passages(text):
            if level:
                look = lambda u: max((x for x in held.get((conv, norm(u)), ()) if x < turn and len(norm(u)) >= min_chars), default=None)  # noqa: E731, B023
                whole = look("\n".join(body))
                best = whole if whole is not None else max((x for x in map(look, body) if x is not None), default=None)
                if best is not None:
                    found.add((conv, turn, level, best))
    return found


def test_quote_links_equal_brute_force(spark):
    rng = random.Random(31)
    rows = []
    for conv in range(6):
        said = []
        for turn in range(40):
            parts = []
            for _ in range(rng.randint(1, 3)):
                if said and rng.random() < 0.6:
                    parts.append("\n".join(rng.choice(["> ", ">", "> > "]) + x for x in rng.choice(said).split("\n")[: rng.randint(1, 3)]))
                body = "\n".join(" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randint(2, 4))) for _ in range(rng.randint(1, 2)))
                parts.append(body)
                said.append(body)
            rows.append((conv, turn, "user", "\n\n".join(parts)))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = {(r.conv_id, r.turn, r.level, r.original_turn) for r in quote_links.quote_links(frame, block=8).collect() if r.original_turn is not None}
    assert got == brute_links(rows) and len(got) > 100


def test_quote_links_take_time_in_proportion_to_the_message(spark):
    """4,000 quotes in one message, all linked, in little more time than 500."""
    import time

    took = []
    for n in (500, 4000):
        said = "\n".join(f"line number {i} says words" for i in range(n))
        answer = "\n".join(f"> line number {i} says words\nanswer to {i} goes here" for i in range(n))
        frame = spark.createDataFrame([(1, 0, "u", said), (1, 1, "a", answer)], "conv_id long, turn long, role string, text string")
        start = time.time()
        got = {r.turn: (r.n_quotes, r.n_linked, r.parent_turn) for r in quote_links.reply_order(frame).collect()}
        took.append(time.time() - start)
        assert got == {0: (0, 0, None), 1: (n, n, 0)}
    assert took[1] < 2 * took[0] + 10


def test_quote_links_replace_clashing_columns(spark):
    names = "n_quotes n_linked parent_turn branch_depth reply_order _lines _starts _conv _turn".split()
    frame = spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string")
    odd = frame.withColumns({n: F.lit("clash") for n in names} | {"level": F.lit("mine"), "h1": F.lit("mine"), "part": F.lit(7)})
    want = sorted(str(tuple(r)) for r in quote_links.reply_order(frame).select("conv_id", "turn", "role", "text", "n_quotes", "n_linked", "reply_order").collect())
    out = quote_links.reply_order(odd)
    assert sorted(str(tuple(r)) for r in out.select("conv_id", "turn", "role", "text", "n_quotes", "n_linked", "reply_order").collect()) == want
    assert out.where("level = 'mine' and h1 = 'mine' and part = 7").count() == len(CHAT) and "_lines" not in out.columns


def test_stages_on_odd_documents(spark, tmp_path, odd):
    """Nulls, repeated rows and clashing columns through every filtering stage: no row is invented, none without a reason
    is lost, the columns stay."""
    where, _, _ = corpus(spark, tmp_path)
    extra = spark.createDataFrame([(0, "Another text of document zero, clean and short."), (None, "A text without an id, clean and short.")], "doc_id long, text string")
    docs = odd.unionByName(extra, allowMissingColumns=True).withColumns({"predicted": F.lit("mine"), "_leak": F.lit("mine")})
    before = [(r.doc_id, r.text) for r in docs.collect()]
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, where)
        assert out.columns == docs.columns, name
        left = [(r.doc_id, r.text) for r in out.collect()]
        if name == "toxicity":  # the labels of this folder belong to other texts: any row may go, none may come
            assert not Counter(left) - Counter(before) and sum(not x[1] for x in left) == sum(not x[1] for x in before)
            continue
        if name in ("line_dedup", "decontamination"):
            assert sorted(str(d) for d, _ in left) == sorted(str(d) for d, _ in before), name
        else:
            assert set(left) <= set(before) and len(left) == len({x for x in left if x[0] is not None and x[1]}) + sum(x[0] is None or not x[1] for x in left), name
        for row in extra.collect():
            assert left.count((row.doc_id, row.text)) == 1, name
    pieces = corpus_pipeline.pack_sequences(spark, docs, where)
    assert pieces.where("start = 0").count() == len(before)


def test_quote_links_on_empty_input(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert quote_links.reply_order(none).count() == 0
