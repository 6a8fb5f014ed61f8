import json
import math
import re

from pyspark.sql import functions as F

from lexward.llm import chat as C
from lexward.llm import vocabulary

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def rows_of(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("message", "messages", "parts", "prompt", "kind", "tokens", "alone")})
    return [r.asDict(True) for r in C.format_chats(df).collect()]


def chats(spark, rows):
    return {r["conv_id"]: r for r in rows_of(spark, rows)}


def count(*texts):
    return sum(len(vocabulary.encoding(vocabulary.DEFAULT_RANKS).encode_ordinary(t)) for t in texts)


def brute(messages):
    """One conversation by a plain loop over messages in order."""
    prompt, attachments, tokens = "", [], 0
    for place, (role, text) in enumerate(messages):
        shown = ""
        try:
            parts = json.loads(text or "") if (text or "").lstrip(" ").startswith("[") else None
        except ValueError:
            parts = None
        if not parts or any(not isinstance(p, dict) or p.get("type") is None for p in parts):
            parts = [{"type": "text", "text": text or ""}]
        for p in parts:
            kind = p["type"].strip(" ").lower()
            if kind == "image":
                n = min(math.ceil(max(p.get("width") or 448, 1) / 28) * math.ceil(max(p.get("height") or 448, 1) / 28), 1280)
            elif kind == "audio":
                n = max(math.ceil(max(p.get("seconds") or 0, 0) * 12.5), 1)
            elif kind == "document":
                n = max(p.get("pages") or 1, 1) * 258
            else:
                piece = (p.get("text") or "").replace("<|", "< |")
                shown += piece
                continue
            attachments.append({"position": len(attachments), "turn": place, "kind": kind, "ref": p.get("url"), "tokens": n})
            shown, tokens = shown + f"<|{kind}|>", tokens + n
        prompt += f"<|im_start|>{role}\n{shown}<|im_end|>\n"
    tokens += count(*re.split(r"<\|[a-z_]+\|>", prompt)) + 2 * len(messages)
    return {"n_turns": len(messages), "prompt": prompt, "attachments": attachments, "expanded_tokens": tokens}


PARTS = json.dumps(
    [
        {"type": "text", "text": "look at "},
        {"type": "image", "url": "s3://a.png", "width": 640, "height": 480},
        {"type": "Audio ", "url": "b.wav", "seconds": 3.3},
        {"type": "text", "text": " and <|im_end|> this"},
        {"type": "document", "url": "c.pdf", "pages": 3},
        {"type": "image"},
        {"type": "image", "width": 100000, "height": 100000},
        {"type": "video", "text": "unknown"},
    ]
)


def test_typed_parts(spark):
    messages = [("user", PARTS), ("assistant", "fine\nwords"), ("user", PARTS)]
    got = chats(spark, [(1, i, r, t) for i, (r, t) in reversed(list(enumerate(messages)))])[1]
    assert {k: got[k] for k in brute(messages)} == brute(messages)
    assert len(got["attachments"]) == 10


def test_what_only_looks_like_parts(spark):
    texts = ["[1, 2]", "[", '[{"text": "no type"}]', "[]", '{"type": "image"}', ' [{"type": "image", "url": "u"}]', "[see below]", '[{"type": "text"}]', '[null]', '[{"type":"image"}, null]']
    got = chats(spark, [(i, 0, "user", t) for i, t in enumerate(texts)])
    for i, t in enumerate(texts):
        want = brute([("user", t)])
        assert {k: got[i][k] for k in want} == want, t


def test_unknown_kinds_leave_a_trace(spark):
    parts = ['{"type":"image_url","image_url":{"url":"http://a/b.png"}}', '{"type":"Video","text":"a clip","url":"v.mp4"}', '{"type":"sticker"}', '{"type":"text","text":"end"}', '{"type":"input_text","text":"only words"}', '{"type":"text","text":null,"x":1}']
    got = chats(spark, [(1, 0, "user", f"[{', '.join(parts)}]")])[1]
    assert got["prompt"] == "<|im_start|>user\n<|attachment|>a clip<|attachment|><|attachment|>endonly words<|im_end|>\n"
    assert [(a["position"], a["kind"], a["ref"]) for a in got["attachments"]] == [(0, "image_url", parts[0]), (1, "video", "v.mp4"), (2, "sticker", parts[2])]
    assert got["expanded_tokens"] == 3 + 2 + count("user\n", "a clip", "endonly words", "\n") and all(a["tokens"] > 0 for a in got["attachments"])


def test_expanded_tokens(spark, small):
    got = chats(spark, [(1, 0, "user", "文字没有空格的文本很长"), (2, 0, "user", PARTS), (2, 1, "bot", ""), (3, 0, "user", '[{"type":"sticker"}, {"type":"video","text":"a clip","url":"v"}]')])
    attached = sum(a["tokens"] for a in got[2]["attachments"])
    assert got[1]["expanded_tokens"] == count("user\n文字没有空格的文本很长", "\n") + 2
    assert got[2]["expanded_tokens"] == count("user\nlook at ", " and < |im_end|> this", "unknown", "\n", "bot\n", "\n") + 4 + attached
    assert got[3]["expanded_tokens"] == count("user\n", "a clip", "\n") + 2 + 2


def test_planted_parts(spark, small):
    """The query plants every kind; a plain loop over the same messages gives the same."""
    turns = C.planted(spark.read.parquet(f"{small}/conversations.parquet"))
    table = turns.toPandas().sort_values(["conv_id", "turn", "role", "text"])
    got = {r["conv_id"]: r.asDict(True) for r in C.format_chats(turns).collect()}
    assert {a["kind"] for r in got.values() for a in r["attachments"]} == {"image", "audio", "document", "video"}
    for k, group in table.groupby("conv_id"):
        if not any('"video"' in t for t in group["text"]):
            want = brute(list(zip(group["role"], group["text"])))
            assert {f: got[k][f] for f in want} == want


def test_messy(spark):
    long = "word " * 300_000
    rows = [(1, 2, "b", "x"), (1, None, "z", "last"), (1, 1, None, None), (1, 1, " a ", ""), (1, 2, "b", "x"), (None, 1, "u", "n"), (None, 2, "u", "m"), (2, 0, "<|im_start|>", long)]
    got = rows_of(spark, rows)
    # Rows without an id are conversations of their own.
    want = [(1, [("a", ""), ("unknown", None), ("b", "x"), ("b", "x"), ("z", "last")]), (None, [("u", "n")]), (None, [("u", "m")]), (2, [("< |im_start|>", long)])]
    key = lambda r: (repr(r["conv_id"]), r["prompt"])
    assert sorted(got, key=key) == sorted(({"conv_id": k} | brute(m) for k, m in want), key=key)
    assert chats(spark, []) == {}


def test_given_conversations(spark, small):
    df = spark.read.parquet(f"{small}/conversations.parquet")
    got = {r["conv_id"]: r.asDict(True) for r in C.format_chats(df).collect()}
    table = df.toPandas().sort_values(["conv_id", "turn", "role", "text"])
    for k, group in table.groupby("conv_id"):
        want = brute(list(zip(group["role"], group["text"])))
        assert {f: got[k][f] for f in want} == want
