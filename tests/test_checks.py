import base64
import json
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inductra.functions import labels, replies, text
from inductra.operators import checks

from rows import by

# Text expressions ----------------------------------------------------------------


def apply(spark, expression, *values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in df.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


def test_trim_strips_every_kind_of_space(spark):
    assert apply(spark, text.trim_all, "\n\t a b 　﻿", "   ", None, "x\n") == ["a b", "", None, "x"]


def test_blank_and_default(spark):
    assert apply(spark, text.blank_to_null, " \n", " a ", None) == [None, "a", None]
    assert apply(spark, lambda c: text.or_default(c, "d"), "", None, "x", " ") == ["d", "d", "x", " "]


def test_escape_html(spark):
    assert apply(spark, text.escape_html, "<a href=\"x\">&'", None) == ["&lt;a href=&quot;x&quot;&gt;&amp;&#039;", ""]
    assert apply(spark, lambda c: text.escape_html(c, "&#39;"), "'") == ["&#39;"]


def test_fences(spark):
    values = ["```json\n{}\n```", "```JSON {}```", "``` {} ```\n", "{}", "```", None, "a ``` b"]
    assert apply(spark, text.strip_fences, *values) == ["{}", "{}", "{}", "{}", "", "", "a ``` b"]


def test_data_urls(spark):
    values = [
        "data:image/png;base64,QUJD", "data:image/svg+xml;base64,QQ==", "data:text/plain;base64,QQ==",
        "data:image/png;base64,", "data:image/png;base64,QQ\nQQ", "x", None, "data:image/png;base64,QQ\n",
    ]
    assert apply(spark, text.data_url_mime, *values) == ["image/png", "image/svg+xml", None, None, None, None, None, None]
    assert apply(spark, text.data_url_payload, *values)[:3] == ["QUJD", "QQ==", None]


def test_content_type(spark):
    values = ["image/png; charset=x", "image/webp", "", None]
    assert apply(spark, text.bare_content_type, *values) == ["image/png", "image/webp", "image/jpeg", "image/jpeg"]


def test_labels(spark):
    assert apply(spark, labels.role_label, "sys_admin", "other", None) == ["System Administrator", "Employee", "Employee"]
    assert apply(spark, labels.status_label, "in_progress", "", None) == ["in progress", "not started", "not started"]
    assert apply(spark, labels.new_role, "sys_admin", "location_manager", "x", None) == ["sysAdmin", "locationManager", "x", None]
    assert apply(spark, labels.old_role, "sysAdmin", "employee") == ["sys_admin", "employee"]
    day = "timestamp_ntz"
    from datetime import datetime
    assert apply(spark, labels.date_label, datetime(2024, 3, 5, 14), None, kind=day) == ["5 Mar 2024", "Not set"]
    with_time = lambda c: labels.date_label(c, with_time=True)
    assert apply(spark, with_time, datetime(2024, 3, 5, 14, 5), kind=day) == ["5 Mar 2024, 2:05 pm"]
    assert apply(spark, labels.short_date, datetime(2024, 3, 5), None, kind=day) == ["05/03/2024", "—"]


# Strict JSON ---------------------------------------------------------------------

VALID = ['{"a":1}', "[1,2]", "7", '"x"', "true", "1e999", '{"a":{"b":[1]}}', '{"a":1,"a":2}', " {} ", '[{"a":1}]']
INVALID = [
    "", "no", "{'a':1}", '{"a":1} tail', '{"a":1}}', "1],[2", '1},{"v":2', '{"a":01}', '{"a":NaN}', "'x'", "{a:1}",
    '{"a":1}{"b":2}', "[1", '{"a":"b', "1,2", '{"a":1,}', "NaN", "undefined",
]


def test_json_kind_agrees_with_a_strict_parser(spark):
    kind = lambda c: replies.json_kind(c, replies.parse_fields(c, "a"))
    got = apply(spark, lambda c: kind(text.trim_all(c)), *VALID, *INVALID, "null")
    want = ["object" if v.strip().startswith("{") else "other" for v in VALID] + ["invalid"] * len(INVALID) + ["null"]
    assert got == want


def strict_kind(value):
    def refuse(_):
        raise ValueError

    try:
        parsed = json.loads(value, parse_constant=refuse)
    except ValueError:
        return "invalid"
    return "null" if parsed is None else "object" if isinstance(parsed, dict) else "other"


@pytest.mark.parametrize("seed", range(2))
def test_json_kind_on_damaged_replies(spark, seed):
    rng = random.Random(seed)
    values = []
    for _ in range(1500):
        value = rng.choice([*VALID, '{"verdict":"pass","confidence":0.25,"explanation":"a, {b} [c]"}']).strip()
        for _ in range(rng.randrange(3)):
            i = rng.randrange(len(value) + 1)
            piece = rng.choice(["", "", *'{}[],:"\'\\01.e-+ ntf', "null", "\\u00", '"a":'])
            value = value[:i] + piece + value[i + rng.randrange(2):]
        values.append(value.strip())
    kind = lambda c: replies.json_kind(c, replies.parse_fields(c, "verdict", "a"))
    got = apply(spark, kind, *values)
    wrong = [(v, g, strict_kind(v)) for v, g in zip(values, got) if g != strict_kind(v)]
    assert not wrong, wrong[:10]


def test_reply_text_of_a_response_body(spark):
    body = json.dumps({"candidates": [{"content": {"parts": [{"text": " hi "}]}}]})
    assert apply(spark, replies.reply_text, body, "{}", None) == [" hi ", None, None]


# Requests ------------------------------------------------------------------------


def check_rows(spark, rows):
    return spark.createDataFrame(rows, "request_id int, question string, staff_photo string, product_name string, n_candidates int")


PHOTO = "data:image/png;base64," + base64.b64encode(b"png").decode()


def test_request_validation_order(spark):
    rows = check_rows(
        spark,
        [(1, "  ", None, "", 0), (2, "q", "text", "", 0), (3, "q", "text", "p", 1), (4, None, PHOTO, None, None), (5, "q", PHOTO, "p", 2)],
    )
    def reasons(kind):
        accepted, rejected = checks.validate_requests(rows, kind)
        out = {r.request_id: None for r in accepted.collect()}
        out.update({r.request_id: r.reason for r in rejected.collect()})
        return [out[i] for i in range(1, 6)]

    assert reasons("question") == [checks.NO_QUESTION, None, None, checks.NO_QUESTION, None]
    assert reasons("photo") == [checks.NO_STAFF_PHOTO, checks.NO_PRODUCT, checks.BAD_STAFF_PHOTO, checks.NO_PRODUCT, None]
    assert reasons("identify") == [checks.NO_PHOTO, checks.NO_CANDIDATES, checks.BAD_PHOTO, checks.NO_CANDIDATES, None]


def test_photo_bytes(spark):
    rows = check_rows(spark, [(1, "", PHOTO, "", 0), (2, "", "data:image/gif;base64,!!", "", 0), (3, "", "x", "", 0)])
    out = by(checks.decode_photos(rows), "request_id")
    assert (bytes(out[1].photo), out[1].mime_type) == (b"png", "image/png")
    assert out[2].photo is None and 3 not in out


PRODUCT = "struct<name:string,category:string,description:string,reject_note:string,keywords:string>"


def product(name, category=None):
    return (name, category, "firm", "", None)


def test_product_context(spark):
    rows = [
        (1, None, product("Kiwi", "Fruit")), (2, [product("A"), product(""), product(None), product("B")], product("no")),
        (3, [product("")], product("ignored")), (4, [], product("single")), (5, None, None), (6, [product("One")], None),
    ]
    df = spark.createDataFrame(rows, f"request_id int, products array<{PRODUCT}>, product {PRODUCT}")
    out = {i: r.context for i, r in by(checks.product_context(df, "Depot"), "request_id").items()}
    facts = "Category: unknown\nAccept / good quality: firm\nReject / fails standard: not recorded\nKeywords: none"
    assert out[1] == "--- Product: Kiwi ---\n" + facts.replace("unknown", "Fruit")
    assert out[2] == f"--- Product 1: A ---\n{facts}\n\n--- Product 2: B ---\n{facts}"
    assert out[3] == out[5] == checks.NO_PRODUCT_BLOCK.format(house="Depot")
    assert out[4].startswith("--- Product: single ---") and out[6].startswith("--- Product: One ---")


@pytest.mark.parametrize("hot_rows", [2, 1000])
def test_blocks_and_candidates_of_a_request_with_very_many_products(spark, hot_rows):
    products = spark.range(40).selectExpr(
        "id", "if(id = 5, '', concat('p', id)) AS name", "if(id % 2 = 0, 'c', NULL) AS category",
        "'d' AS description", "'' AS reject_note", "'k' AS keywords",
    )
    pairs = spark.createDataFrame([(1, i) for i in range(40)] + [(2, 3)], "request_id bigint, product_id bigint")
    blocks = by(checks.product_blocks(pairs, products, hot_rows), "request_id", "position")
    assert len(blocks) == 40 and blocks[1, 6].product_id == 6
    assert blocks[1, 6].block.startswith("--- Product 6: p6 ---")
    assert blocks[2, 1].block.startswith("--- Product: p3 ---")
    lines = by(checks.candidate_positions(pairs, products, hot_rows), "request_id", "position")
    assert lines[1, 6].line == "6. " and lines[1, 7].line == "7. p6 (c)" and len(lines) == 41


def test_candidate_list(spark):
    df = spark.createDataFrame([(1, [(5, "Kiwi", "Fruit"), (6, "Box", ""), (7, "Bag", None)])], "request_id int, candidates array<struct<id:int,name:string,category:string>>")
    assert checks.candidate_list(df).first().candidate_text == "1. Kiwi (Fruit)\n2. Box\n3. Bag"


def test_prompt_parts(spark):
    rows = [
        (1, PHOTO, "Kiwi", True, "g", "r"), (2, PHOTO, "Kiwi", False, None, "r"), (3, PHOTO, "Kiwi", None, "g", None),
        (4, PHOTO, "Kiwi", False, "g", "r"), (5, PHOTO, "Kiwi", False, "g", "lost"), (6, PHOTO, "Kiwi", False, "lost", "r"),
    ]
    df = spark.createDataFrame(rows, "request_id int, staff_photo string, product_name string, text_only boolean, good_url string, reject_url string")
    df = df.selectExpr("*", "'' AS category", "'firm' AS description", "NULL AS reject_note", "NULL AS keywords")
    refs = spark.createDataFrame([("g", "image/webp; q=1", "R09PRA=="), ("r", None, "QkFE")], "url string, content_type string, data string")
    prepared, rejected = checks.prompt_parts(df, refs, "Depot")
    out = {i: r.parts for i, r in by(prepared, "request_id").items()}
    assert {i: len(p) for i, p in out.items()} == {1: 2, 2: 2, 3: 5, 4: 7, 5: 5}
    assert [r.request_id for r in rejected.collect()] == [6]
    assert out[1][0].text.startswith("You check product quality for Depot. The photo shows one batch.")
    assert (out[1][1].mime_type, out[1][1].text) == ("image/png", None)
    assert [p.data for p in out[4] if p.data] == ["R09PRA==", "QkFE", PHOTO.split(",")[1]]
    assert [p.mime_type for p in out[4] if p.data] == ["image/webp", "image/jpeg", "image/png"]
    assert out[4][1].text == "Example of an acceptable batch of Kiwi:" and out[4][5].text == checks.STAFF_CAPTION
    assert "Reject criteria (FAILS standard): not recorded" in out[4][0].text


# Verdicts ------------------------------------------------------------------------

CASES = {
    '{"verdict":"pass","confidence":0.9,"explanation":"firm"}': ("parsed", "pass", 0.9, "firm"),
    '```json\n{"verdict":"fail","confidence":1.7,"explanation":"x"}\n```': ("parsed", "fail", 1.0, "x"),
    '``` {"verdict":"uncertain","confidence":-1} ```': ("parsed", "uncertain", 0.0, ""),
    '{"verdict":"maybe","confidence":"0.9","explanation":5}': ("parsed", "uncertain", None, ""),
    '{"verdict":"PASS"}': ("parsed", "uncertain", None, ""),
    '{"verdict":"pass","confidence":"NaN"}': ("parsed", "pass", None, ""),
    '{"verdict":"pass","confidence":1e999}': ("parsed", "pass", 1.0, ""),
    '{"verdict":"fail","verdict":"pass"}': ("parsed", "pass", None, ""),
    '{"verdict": "FAIL", "explanation": "cut off", "confid': ("salvaged", "fail", None, "cut off"),
    '{"verdict":"pass"} trailing': ("salvaged", "pass", None, ""),
    "{'verdict':'pass'}": ("failed", None, None, None),
    "no idea": ("failed", None, None, None),
    "": ("failed", None, None, None),
    "null": ("failed", None, None, None),
    "7": ("parsed", "uncertain", None, ""),
    '[{"verdict":"pass"}]': ("parsed", "uncertain", None, ""),
    '"pass"': ("parsed", "uncertain", None, ""),
    '{"explanation":null,"confidence":true}': ("parsed", "uncertain", None, ""),
}


def test_verdicts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)] + [(99, None)], "i int, reply_text string")
    out = by(checks.normalise_verdicts(df), "i")
    got = [(out[i].reply_status, out[i].verdict, out[i].confidence, out[i].explanation) for i in range(len(CASES))]
    assert got == list(CASES.values())
    assert out[99].reply_status == "failed"


def plain_verdict(value):
    """One reply, read step by step without Spark."""
    raw = value.strip()
    raw = re.sub(r"\A```json\s*", "", raw, flags=re.I)
    raw = re.sub(r"\A```\s*", "", raw)
    raw = re.sub(r"```\s*\Z", "", raw).strip()
    kind = strict_kind(raw)
    if kind == "null":
        return ("failed", None, None, None)
    if kind == "invalid":
        verdict = re.search(r'"verdict"\s*:\s*"(pass|fail|uncertain)"', raw, re.I)
        reason = re.search(r'"explanation"\s*:\s*"([^"]+)"', raw)
        if not verdict:
            return ("failed", None, None, None)
        return ("salvaged", verdict[1].lower(), None, reason[1] if reason else "")
    fields = json.loads(raw) if kind == "object" else {}
    verdict, confidence, reason = (fields.get(k) for k in ("verdict", "confidence", "explanation"))
    number = isinstance(confidence, (int, float)) and not isinstance(confidence, bool)
    return (
        "parsed",
        verdict if verdict in ("pass", "fail", "uncertain") else "uncertain",
        max(0.0, min(1.0, float(confidence))) if number else None,
        reason if isinstance(reason, str) else "",
    )


def damaged(rng, texts, pieces):
    value = rng.choice(texts)
    for _ in range(rng.randrange(4)):
        i = rng.randrange(len(value) + 1)
        value = value[:i] + rng.choice(pieces) + value[i + rng.randrange(2):]
    return value


def test_verdicts_of_damaged_replies(spark):
    rng = random.Random(11)
    pieces = ["", "", *'{}",: \n1.-', "```", "```json ", '"verdict":"fail"', '"explanation": "why"', "null", '"confidence":2']
    values = [damaged(rng, list(CASES), pieces) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, reply_text string")
    out = by(checks.normalise_verdicts(df), "i")
    got = [(out[i].reply_status, out[i].verdict, out[i].confidence, out[i].explanation) for i in range(len(values))]
    wrong = [(v, g, plain_verdict(v)) for v, g in zip(values, got) if g != plain_verdict(v)]
    assert not wrong, wrong[:5]


MATCHES = {
    '{"match":true,"index":1,"confidence":0.9}': ("parsed", 11, 0.9),
    '{"match":true,"index":2,"confidence":0.35}': ("parsed", 12, 0.35),
    '{"match":true,"index":1,"confidence":0.34}': ("parsed", None, 0.34),
    '{"match":false,"index":1,"confidence":0.9}': ("parsed", None, 0.9),
    '{"match":"yes","index":1,"confidence":1}': ("parsed", 11, 1.0),
    '{"match":"","index":1,"confidence":1}': ("parsed", None, 1.0),
    '{"match":0,"index":1,"confidence":1}': ("parsed", None, 1.0),
    '{"match":{},"index":1,"confidence":1}': ("parsed", 11, 1.0),
    '{"match":true,"index":0,"confidence":1}': ("parsed", None, 1.0),
    '{"match":true,"index":3,"confidence":1}': ("parsed", None, 1.0),
    '{"match":true,"index":"1","confidence":1}': ("parsed", None, 1.0),
    '{"match":true,"index":1}': ("parsed", None, 0.0),
    '{"match":true,"index":1.5,"confidence":1}': ("error", None, None),
    '{"match":true,"index":2.5,"confidence":1}': ("error", None, None),
    '{"match":true,"index":0.5,"confidence":1}': ("parsed", None, 1.0),
    '{"match":true,"index":1e300,"confidence":1}': ("parsed", None, 1.0),
    "[1]": ("parsed", None, 0.0),
    "null": ("error", None, None),
    '{"match":true,"index":2,"conf': ("salvaged", 12, 0.5),
    '{"match":false,"index":1,"confidence":0.1} tail': ("salvaged", 11, 0.1),
    '"index": 1, "confidence": 0.8.1': ("salvaged", 11, 0.8),
    '"index": 9, "confidence": 0.8': ("failed", None, None),
    '"index": 99999999999999999999999 x': ("failed", None, None),
    "sorry": ("failed", None, None),
    "": ("failed", None, None),
}


def test_product_matches(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(MATCHES)], "request_id bigint, reply_text string")
    listed = spark.createDataFrame(
        [(i, p, 10 + p, f"p{p}") for i in range(len(MATCHES)) for p in (1, 2)],
        "request_id bigint, position bigint, product_id bigint, name string",
    )
    out = by(checks.match_products(df, listed), "request_id")
    got = [(out[i].match_status, out[i].product_id, out[i].match_confidence) for i in range(len(MATCHES))]
    assert got == list(MATCHES.values())
    assert all((r.product_name is None) == (r.product_id is None) for r in out.values())


ATTEMPTS = "request_id bigint, attempt_rank bigint, model string, ok boolean, status int, error_message string, reply_text string"
PASS, FAIL = '{"verdict":"pass"}', '{"verdict":"fail"}'


def test_first_success_in_model_order(spark):
    rows = [
        (1, 2, "c", True, 200, None, FAIL), (1, 0, "a", False, 429, "quota", PASS), (1, 1, "b", True, 200, None, PASS),
        (2, 0, "a", False, 500, None, ""), (2, 1, "b", True, 200, None, "x" * 100), (2, 2, "c", True, 200, None, "null"),
        (2, 3, "d", False, 404, "gone", ""),
    ]
    out = by(checks.first_success(spark.createDataFrame(rows, ATTEMPTS)), "request_id")
    assert (out[1].succeeded, out[1].attempt_rank, out[1].model, out[1].verdict, out[1].error) == (True, 1, "b", "pass", None)
    assert out[2].error == (
        "AI service unavailable. Details: a: 500 | b: JSON parse failed — " + "x" * 80 + " | c: reply is null"
    )
    assert (out[2].succeeded, out[2].verdict, out[2].n_attempts) == (False, None, 4)


def test_first_answer_lists_every_error(spark):
    rows = [(1, i, f"m{i}", i % 2 == 0, 500, "e", " \n") for i in range(5)] + [(2, 0, "m0", True, 200, None, " yes ")]
    out = by(checks.first_success(spark.createDataFrame(rows, ATTEMPTS), "question"), "request_id")
    assert out[1].error.count(" | ") == 4 and out[1].error.startswith("AI service unavailable. Tried: m0: empty response | m1: 500 e")
    assert out[2].answer == "yes"


def test_any_rank_counts_and_no_request_is_lost(spark):
    rows = [(1, 7, "h", True, 200, None, PASS), (2, 9, "z", False, 500, None, ""), (2, 6, "g", False, 429, "quota", ""),
            (3, None, "n", True, 200, None, FAIL), (3, 40, "m", False, 500, "x", ""), (4, None, "n", False, 500, "y", "")]
    attempts = spark.createDataFrame(rows, ATTEMPTS)
    out = by(checks.first_success(attempts), "request_id")
    assert set(out) == {1, 2, 3, 4}
    assert (out[1].attempt_rank, out[1].verdict) == (7, "pass")
    assert out[2].error == "AI service unavailable. Details: g: 429 quota | z: 500"
    assert (out[3].succeeded, out[3].attempt_rank, out[3].verdict) == (True, None, "fail")
    assert out[4].error == "AI service unavailable. Details: n: 500 y"
    asked = by(checks.first_success(attempts, "question"), "request_id")
    assert asked[2].error == "AI service unavailable. Tried: g: 429 quota | z: 500 "


def test_several_errors_of_one_rank_are_all_listed(spark):
    rows = [(1, 0, m, False, 500, m, "") for m in ("b", "a")] + [(2, i, "m", False, 500, "e", "") for i in range(60)]
    attempts = spark.createDataFrame(rows, ATTEMPTS)
    assert by(checks.first_success(attempts), "request_id")[1].error.endswith("a: 500 a | b: 500 b")
    assert by(checks.first_success(attempts, "question"), "request_id")[2].error.endswith(" | and 10 more")
    lines = checks.error_lines(attempts, "question").where("request_id = 2").collect()
    assert sorted(r.position for r in lines) == list(range(1, 61))


def test_attempts_outside_the_model_list_are_reported(spark):
    rows = [(1, 0, "a", True, 200, None, PASS), (1, 0, "a", True, 200, None, PASS), (2, 5, "f", True, 200, None, PASS), (3, 1, "b", True, 200, None, PASS)]
    out = by(checks.attempt_problems(spark.createDataFrame(rows, ATTEMPTS)), "request_id")
    assert {i: r.reason for i, r in out.items()} == {1: "request_id+attempt_rank:unique", 2: "attempt_rank:range"}
    assert math.isfinite(len(out))


def test_replies_are_parsed_in_few_places(spark):
    """A filter that is pushed below the parsing would copy it into each place that names a part."""
    text = F.concat(F.lit('{"match":true,"confidence":1,"index":'), F.col("id").cast("string"), F.lit("}"))
    replies = spark.range(4).select(F.col("id").alias("request_id"), text.alias("reply_text"))
    pairs = spark.createDataFrame([(r, p) for r in range(4) for p in (11, 12)], "request_id bigint, product_id bigint")
    products = spark.createDataFrame([(11, "a"), (12, "b")], "id bigint, name string")
    out = checks.match_pairs(replies, pairs, products)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("from_json(") < 20
    assert {r.request_id: r.product_name for r in out.collect()} == {0: None, 1: "a", 2: "b", 3: None}


def test_requests_of_one_url_are_dealt_to_many_parts(spark):
    spread = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    known = {name: spark.conf.get(name) for name in spread}
    rows = [(i, PHOTO, "Kiwi", False, "g", "lost" if i % 2 else "r") for i in range(400)]
    df = spark.createDataFrame(rows, "request_id int, staff_photo string, product_name string, text_only boolean, good_url string, reject_url string")
    df = df.selectExpr("*", "'' AS category", "'firm' AS description", "NULL AS reject_note", "NULL AS keywords")
    refs = spark.createDataFrame([("g", "image/webp", "R09PRA=="), ("r", None, "QkFE")], "url string, content_type string, data string")
    try:
        for name, value in spread.items():
            spark.conf.set(name, value)
        prepared, rejected = checks.prompt_parts(df, refs)
        found = prepared.select("request_id", F.size("parts").alias("n"), F.spark_partition_id().alias("task")).collect()
        assert rejected.count() == 0
    finally:
        for name, value in known.items():
            spark.conf.set(name, value)
    assert {r.request_id: r.n for r in found} == {i: 5 if i % 2 else 7 for i in range(400)}
    assert max(Counter(r.task for r in found).values()) < 150
