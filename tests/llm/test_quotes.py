import random
import re

from grapheion.llm import quotes


def normal(t):
    return re.sub(r"\s+", " ", t.lower()).strip(" ")


def parse(text):
    out = []
    for line in re.sub("\r\n?", "\n", text or "").split("\n"):
        marks = re.match(r"(?:[ \t]*>)*", line)[0]
        out.append((marks.count(">"), line[len(marks) :].removeprefix(" ") if marks else line))
    att = re.compile(r"(?i)^[ \t]*(on|am|le|el)\b.{0,200}\b(wrote|schrieb|écrit|escribió)[ \t]*:[ \t]*$")
    return [(lv, x) for i, (lv, x) in enumerate(out) if not (att.search(x) and i + 1 < len(out) and out[i + 1][0] > lv)]


def brute(rows):
    """Expected (conv_id, turn, clean_text, parent_turn, thread_turn, depth, position), unique turns."""
    msgs = {(c, t): parse(x) for c, t, x in rows}

    def keys(parts):
        return {normal(p): len(normal(p)) for p in parts if normal(p)}

    own = {}
    for k, lines in msgs.items():
        mine = [x for lv, x in lines if lv == 0]
        own[k] = keys(["\n".join(mine), *re.split(r"\n\s*\n", "\n".join(mine)), *mine])
    parent = {}
    for (c, t), lines in msgs.items():
        passages, last = [], 0
        for lv, x in lines:
            if lv and lv == last:
                passages[-1][1] += "\n" + x
            elif lv:
                passages.append([lv, x])
            last = lv
        # the lowest level at which anything is found decides
        for level in sorted({lv for lv, _ in passages}):
            here, votes = [p for lv, p in passages if lv == level], {}
            for key, size in keys(here + [y for p in here for y in p.split("\n")]).items():
                held = [u for (d, u) in msgs if d == c and u < t and key in own[d, u]]
                if held:
                    votes[max(held)] = votes.get(max(held), 0) + size
            if votes:
                parent[c, t] = max((v, u) for u, v in votes.items())[1]
                break
    out = []
    for c in {c for c, _ in msgs}:
        mine = []
        for t in [t for d, t in msgs if d == c]:
            root, depth = t, 0
            while (c, root) in parent:
                root, depth = parent[c, root], depth + 1
            mine.append((root, t, depth))
        for place, (root, t, depth) in enumerate(sorted(mine), 1):
            clean = "\n".join(x for lv, x in msgs[c, t] if lv == 0)
            out.append((c, t, re.sub(r"^\s+|\s+$", "", clean), parent.get((c, t)), root, depth, place))
    return sorted(out)


def corpus():
    rng = random.Random(4)
    rows = []
    for c in range(6):
        texts = []
        for t in range(rng.randrange(1, 14)):
            body = [" ".join(rng.choice(["Hello", "there", "ok", "see", "x"]) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 4))]
            if texts and rng.random() < 0.8:
                quoted = rng.choice(texts).split("\n")
                cut = quoted[rng.randrange(len(quoted)) :]
                body = ["On Monday Ann wrote:", *[">" + " " * (not x.startswith(">")) + x for x in cut], *body]
            texts.append(rng.choice(["\n", "\r\n"]).join(body))
            rows.append((c, t * 150, texts[-1]))
    return rows


def got(spark, rows):
    conv = spark.createDataFrame([(c, t, "user", x, "z") for c, t, x in rows], "conv_id long, turn long, role string, text string, root string").repartition(3)
    return sorted(((r.conv_id, r.turn, r.clean_text, r.parent_turn, r.thread_turn, r.depth, r.position) for r in quotes.link(conv).collect()), key=str)


def test_equals_brute_force(spark):
    rows = corpus()
    want = brute(rows)
    assert sum(w[3] is not None for w in want) > 10 and max(w[5] for w in want) > 2
    assert got(spark, rows) == sorted(want, key=str)


def test_levels_and_attribution(spark):
    rows = [(1, 0, "Where is it?"), (1, 1, "On Tue, Bo wrote:\n> Where is it?\nHere."), (1, 2, "> > where  IS it?\n> Here.\n\nThanks"), (1, 3, "On the hill she wrote:\nno quote")]
    out = {r[1]: r for r in got(spark, rows)}
    assert out[1][2:5] == ("Here.", 0, 0) and out[2][2:6] == ("Thanks", 1, 0, 2) and out[3][2] == "On the hill she wrote:\nno quote"
    assert [out[t][6] for t in range(4)] == [1, 2, 3, 4]


def test_quotes_of_every_level(spark):
    rows = [(1, 0, "Where is it? I have looked for it since yesterday."), (1, 1, "Here."), (1, 2, "> > Where is it? I have looked for it since yesterday.\n> Here.\nThanks"), (1, 3, "> > > nobody wrote this\n> > Here.\nso?")]
    conv = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    out = {r.turn: (r.parent_turn, r.matched_chars, r.n_quotes, r.max_level, [tuple(q) for q in r.quotes]) for r in quotes.link(conv).collect()}
    assert out[2] == (1, 5, 2, 2, [(1, 1, 5), (2, 0, 50)])  # the short answer, not the long question behind it
    assert out[3] == (1, 5, 2, 3, [(2, 1, 5)])  # nothing at the levels around


def test_spans_bring_in_what_stands_before(spark, monkeypatch):
    monkeypatch.setattr(quotes, "SPAN", 4)
    rows = [(5, t, f"> common\n> line {t - 3}\nline {t}\ncommon" if t % 3 else "common") for t in range(0, 60, 1)] + [(6, 1000, "> common\nx")]
    assert got(spark, rows) == sorted(brute(rows), key=str)


def test_full_thread_and_long_text(spark):
    # one thread of many rows, and a message of many quoted lines
    rows = [(1, 0, "first")] + [(1, t, "> first\nre") for t in range(1, 400)] + [(2, 0, "\n".join(f"line {i}" for i in range(3000))), (2, 1, "\n".join(f"> line {i}" if i % 2 else f">> line {i}" for i in range(3000)))]
    out = got(spark, rows)
    assert [r[6] for r in sorted((r for r in out if r[0] == 1), key=lambda r: r[1])] == list(range(1, 401))
    assert [r[3] for r in out if r[0] == 2 and r[1] == 1] == [0]


def test_long_chain(spark):
    rows = [(7, 0, "line 0")] + [(7, t, f"> line {t - 1}\nline {t}") for t in range(1, 60)]
    assert [(r[5], r[4]) for r in sorted(got(spark, rows), key=lambda r: r[1])] == [(t, 0) for t in range(60)]


def test_nulls_repeats_and_empty(spark):
    rows = [(1, 0, "a line"), (1, 0, "a line"), (1, 1, "> a line\nx"), (None, 0, "a line"), (None, 1, "> a line"), (2, None, None), (2, 5, "")]
    out = got(spark, rows)
    assert len(out) == 7 and [r[3] for r in out if r[0] == 1] == [None, None, 0]
    assert [(r[2], r[3]) for r in out if r[0] is None] == [("a line", None), ("", None)]
    conv = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert quotes.link(conv).count() == 0
