import json
import random

from pyspark.sql import functions as F

from tessera.llm.conversations import _effective_times, conversation_lines, judge_sessions, kahn, message_texts, ordered_conversations

ROWS = "key string, parent string, session string, type string, isSidechain boolean, timestamp string, role string, content string, reason string"

WANT = {"sound": None, "no_reply": "no_reply", "broken": "broken", "ring": "broken", "empty": "empty", "side": "no_reply", "other": "no_reply", "result": None, "brackets": None, "hollow": "empty", "knot": "broken", "below": "broken", "through": "broken"}


def line(key, parent, session, type_="user", content="hello", side=False, t="2024-01-01T00:00:00Z", role=None):
    return (key, parent, session, type_, side, t, role, content, "clash")


def test_reasons(spark):
    use = json.dumps([{"type": "tool_use", "id": "x"}])
    rows = [
        line("a1", None, "sound"), line("a2", "a1", "sound", "progress", None), line("a3", "a2", "sound", "assistant", use),
        line("b1", None, "no_reply"), line("b2", "b1", "no_reply"), line("b3", "b2", "no_reply", "assistant"),
        line("c1", "gone", "broken"), line("c2", "c1", "broken", "assistant"),
        line("d1", "d1", "ring"), line("e1", None, "empty", content="  "), line("e2", "e1", "empty", "assistant", json.dumps([{"type": "thinking", "thinking": "x"}])),
        line("f1", None, "side"), line("f2", "f1", "side", "assistant", side=True),
        line("g1", None, "other"), line("g2", "a1", "other", "assistant"),
        line("h1", None, "result", content=json.dumps([{"type": "tool_result", "content": "x"}, {"type": "text", "text": "y"}])), line("h2", "h1", "result", "assistant"),
        line("i1", None, "brackets", content="[1]"), line("i2", "i1", "brackets", "assistant", '"plain"'),
        line("j1", None, "hollow", content="[]"), line("j2", "j1", "hollow", "assistant", " [ ] "),
        line("k1", "k2", "knot"), line("k2", "k1", "knot", "assistant"), line("k3", "k2", "knot", "assistant"),
        line("m1", "c2", "below"), line("m2", "m1", "below", "assistant"), line("n1", "z2", "through"), line("n2", "n1", "through", "assistant"),
        line("z2", "gone", None),
        line("z1", None, None),
    ]
    for hot in (10**6, 1):  # sessions whole, and in units of a line or so
        got = {r.session: r.reason for r in judge_sessions(conversation_lines(spark.createDataFrame(rows, ROWS)), hot).collect()}
        assert got == WANT
    assert judge_sessions(conversation_lines(spark.createDataFrame([], ROWS))).collect() == []


def test_kahn_order_and_left_over():
    order, left = kahn(["a", "b", "c", "d", "e"], [None, "a", "a", "e", "d"], [5, 1, 2, 0, 0])
    assert order == [0, 1, 2] and left == [3, 4]


def test_sliced_order_is_kahns(spark):
    r = random.Random(3)
    rows, want = [], {}
    for s in ("s0", "s1"):
        keys = [f"{s}-{i:03d}" for i in range(200)]
        parents = [None if r.random() < 0.05 or not i else keys[r.randrange(max(0, i - 9), i)] for i in range(200)]
        times = [r.randrange(60) * 10_000_000 if r.random() < 0.9 else None for _ in keys]
        order, left = kahn(keys, parents, [-1 if t is None else t for t in times])
        assert not left
        want[s] = [keys[i] for i in order]
        rows += [(s, k, p, True, r.choice(["user", "assistant"]), t) for k, p, t in zip(keys, parents, times)]
    r.shuffle(rows)
    lines = spark.createDataFrame(rows, "session string, key string, parent string, main boolean, speaker string, micros long").selectExpr("*", "false as side", "speaker = 'user' as is_prompt", "speaker = 'assistant' as is_reply")
    sound = lines.select("session").distinct()
    speaker = {x[1]: x[4] for x in rows}
    for hot in (10**6, 40):
        got = sorted(ordered_conversations(lines, sound, hot).collect(), key=lambda x: (x.session, x.position))
        for s in want:
            mine = [x for x in got if x.session == s]
            assert [x.key for x in mine] == want[s] and [x.position for x in mine] == list(range(200))
            assert [bool(x.same_speaker) for x in mine] == [False] + [speaker[a] == speaker[b] for a, b in zip(want[s], want[s][1:])]
    assert _effective_times(lines).filter(F.col("effective") < F.coalesce("micros", F.lit(-1))).count() == 0


def test_times_and_texts(spark):
    t = ["2024-01-01T00:00:01.5Z", "2024-01-01 00:00:01", "1704067201500", "2024-01-01T02:00:01.500+02:00", None, "soon"]
    rows = [line(str(i), None, "s", t=x) for i, x in enumerate(t)]
    got = {x.key: x.micros for x in conversation_lines(spark.createDataFrame(rows, ROWS)).collect()}
    assert [got[str(i)] for i in range(6)] == [1704067201500000, 1704067201000000, 1704067201500000, 1704067201500000, None, None]
    df = spark.createDataFrame([("a", '[{"type":"text","text":"x"},{"type":"text","text":"y"}]'), ("b", "z")], "uuid string, content string")
    assert {x.uuid: x.text for x in message_texts(df).collect()} == {"a": "x\n\ny", "b": "z"}


def test_roles_and_alternation(spark):
    rows = [line("a", None, "s", role=" Human"), line("b", "a", "s", "assistant", role="AI", t="2024-01-01T00:00:01Z"), line("c", "b", "s", "assistant", role="odd", t="2024-01-01T00:00:02Z"), line("d", "c", "s", "progress", role="user", t="2024-01-01T00:00:03Z")]
    lines = conversation_lines(spark.createDataFrame(rows, ROWS))
    assert {r.key: r.speaker for r in lines.collect()} == {"a": "user", "b": "assistant", "c": "assistant", "d": None}
    assert [(r.n_lines, r.n_repeated, r.reason) for r in judge_sessions(lines).collect()] == [(3, 1, None)]


def _judged(rows):
    """n_repeated and broken of each session, from the rows alone."""
    at = {x[0]: x for x in rows}

    def ends(k):
        seen = set()
        while k is not None and k in at and k not in seen:
            seen.add(k)
            k = at[k][1]
        return k is None

    got = {}
    for s in sorted({x[2] for x in rows if x[2]}):
        mine = [x for x in rows if x[2] == s]
        times = [-1 if x[5] is None else int(x[5]) for x in mine]
        order, left = kahn([x[0] for x in mine], [x[1] for x in mine], times)
        left.sort(key=lambda i: (times[i], mine[i][0]))
        main = [mine[i][3] for i in [*order, *left] if mine[i][3] != "progress" and not mine[i][4]]
        broken = any(not ends(x[0]) for x in mine if x[3] != "progress" and not x[4])
        got[s] = (sum(a == b for a, b in zip(main, main[1:])), broken)
    return got


def test_units_do_not_change_what_is_judged(spark):
    r = random.Random(5)
    rows = []
    for s in range(6):
        keys = [f"s{s}-{i:02d}" for i in range(60)]
        for i, k in enumerate(keys):
            p = None if not i else keys[max(0, i - 1 - r.randrange(3))]
            if s < 2 and r.random() < 0.05:
                p = keys[min(59, i + r.randrange(9))]  # rings
            elif s == 2 and i == 50:
                p = "gone"
            rows.append(line(k, p, f"s{s}" if s < 2 or i != 20 else None, r.choice(["user", "assistant", "progress"]), side=r.random() < 0.1, t=None if r.random() < 0.05 else str(1704067200000 + r.randrange(40) * 1000)))
    want = _judged(rows)
    assert {s for s in want if want[s][1]} == {"s0", "s1", "s2"}
    reasons = []
    for hot in (10**6, 20):
        r.shuffle(rows)
        got = {x.session: x for x in judge_sessions(conversation_lines(spark.createDataFrame(rows, ROWS)), hot).collect()}
        assert {s: (x.n_repeated, x.reason == "broken") for s, x in got.items()} == want
        reasons.append({s: x.reason for s, x in got.items()})
    assert reasons[0] == reasons[1]
