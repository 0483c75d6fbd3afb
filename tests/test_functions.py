import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from ragspark import fixed
from ragspark.functions import numbers, provisions, responses, text

KEYS = {
    "DISP 1.2.1R": "DISP 1.2.1", "DISP 1.2.3G": "DISP 1.2.3", "DISP 1.2.1": "DISP 1.2.1", "DISP 1.3.1AR": "DISP 1.3.1A",
    "DISP 1.5.2AG": "DISP 1.5.2A", "DISP 1.3.1AAR": "DISP 1.3.1AA", "DISP 1.3.1ADR": "DISP 1.3.1AD", "DISP 1.3.1AD": "DISP 1.3.1AD",
    "MCOB 12.4.1BR": "MCOB 12.4.1B", "BCOBS 2A.1.1": "BCOBS 2A.1.1", "COBS 10A.2.1R": "COBS 10A.2.1", "PRIN 2A.2.10": "PRIN 2A.2.10",
    "DISP 1.6.2R(1)": "DISP 1.6.2", "DISP 1.6.2R(2)(a)": "DISP 1.6.2", "disp 1.6.2r": "DISP 1.6.2", "  DISP   1.6.2 R  ": "DISP 1.6.2",
    "DISP\t1.6.2R": "DISP 1.6.2", "": None, "   ": None, "not a provision": None, "DISP": None, "123": None, "DISP APP 1.1.1": None,
}


def test_provision_keys_and_idempotence(spark):
    df = spark.createDataFrame([*KEYS.items(), (None, None)], "ref string, want string")
    key = provisions.provision_key(F.col("ref"))
    got = df.select("ref", "want", key.alias("key"), provisions.provision_key(key).alias("again")).collect()
    assert all(r.key == r.want and r.again == r.want for r in got)


def test_parse_provision(spark):
    row = spark.range(1).select(provisions.parse_provision(F.lit("DISP 1.5.2AR(1)")).alias("p")).first()
    assert tuple(row.p) == ("DISP", "1.5.2A", "R")
    keys = spark.range(1).select(provisions.provision_keys(F.array(*[F.lit(x) for x in ("DISP 1.2.1R", "DISP 1.2.1", "x")]))).first()[0]
    assert keys == ["DISP 1.2.1"]


def test_definitions_are_not_mentions(spark):
    content = (
        "# DISP — DISP 2.8 Title\n\n## DISP 2.8.2 (Rules)\n\ntext DISP 2.8.7 R and DISP 1.6.2A R(2)(a)\n"
        "## DISP 2.8.3 (Guidance) inline ## DISP 2.8.4A (Evidential provisions) ## DISP 1 Annex 3 (Rules) DISP 2.8.2R(2)"
    )
    found = spark.range(1).select(provisions.defined_provisions(F.lit(content))).first()[0]
    assert sorted(found) == ["DISP 2.8.2", "DISP 2.8.3", "DISP 2.8.4A"]


def test_chunk_section(spark):
    df = spark.createDataFrame(
        [("disp2s8", "x"), ("", "s3://b/p/disp1s6-002.md"), (None, "s3://b/p/disp1s6.md"), (None, "")], "s string, c string"
    )
    got = [r[0] for r in df.select(provisions.chunk_section(F.col("s"), F.col("c"))).collect()]
    assert got == ["disp2s8", "disp1s6", None, None]


def test_text_expressions(spark):
    page = '<a href="/handbook/DISP/1/2/">x</a><a href="/other">y</a><a href="/handbook/DISP/1/2">z</a><a href="/handbook/PRIN">p</a>'
    row = spark.range(1).select(
        text.clean_text(F.lit("a&nbsp;&amp;lt;\t\t b &eacute; \n")).alias("clean"), text.links(F.lit(page)).alias("links"),
        text.policy_references(F.lit("PRIN 2, SYSC 6.1.1R; xPRIN, IPRU-INV 1 and PRIN 2")).alias("refs"),
        text.slug(F.lit("  Conflicts of Interest (v2) ")).alias("slug"), text.policy_source_ref(F.lit("a-policy.md")).alias("source"),
        text.spans(F.lit("aaaa"), F.lit("aa")).alias("spans"), text.spans(F.lit("aaaa"), F.lit("")).alias("none"),
        text.truncate(F.lit("abcdef"), 3).alias("cut"), text.truncate(F.lit("abc"), 3).alias("whole"),
        text.token_type(F.lit("[SORT_CODE_3]")).alias("kind"), text.token_type(F.lit("x")).alias("unknown"),
        text.word_count(F.lit("  a b\n c ")).alias("words"), text.token_count(F.lit("Hello, wörld x_1!")).alias("tokens"),
        text.section_heading(F.lit("prin"), F.lit("The Principles"), F.lit("PRIN 2.1.1R"), F.lit("prin2s1")).alias("h1"),
        text.section_heading(F.lit("prin"), F.lit(""), F.lit("PRIN 2.1.1R"), F.lit("prin2s1")).alias("h2"),
        text.section_heading(F.lit("prin"), F.lit(None).cast("string"), F.lit("PRIN"), F.lit("prin2s1")).alias("h3"),
        text.provision_block(F.lit("P 1"), F.lit("Rules"), F.lit("t")).alias("b1"), text.provision_block(F.lit("P 1"), F.lit(""), F.lit("")).alias("b2"),
    ).first()
    assert row.clean == "a &lt; b é"
    assert row.links == ["DISP/1/2", "PRIN"]
    assert row.refs == ["IPRU-INV 1", "PRIN 2", "SYSC 6.1.1R"]
    assert (row.slug, row.source) == ("conflicts-of-interest-v2", "synthetic_a-policy")
    assert [tuple(s) for s in row.spans] == [(0, 2), (1, 3), (2, 4)] and row.none == []
    assert row.cut == "abc" + fixed.TRUNCATION_MARK and row.whole == "abc"
    assert (row.kind, row.unknown, row.words, row.tokens) == ("SORT_CODE", "UNKNOWN", 3, 5)
    assert [row.h1, row.h2, row.h3] == ["# PRIN — The Principles", "# PRIN — PRIN 2.1", "# PRIN — prin2s1"]
    assert [row.b1, row.b2] == ["## P 1 (Rules)\n\nt", ""]


def test_spans_equal_a_scan(spark):
    cases = [("aaaa", "aa"), ("aaaa", ""), ("", "a"), ("xaba\nbab", "ab"), ("a.b a.b axb", "a.b"), ("q\\Ez\\E", "\\E"), ("éaéa", "éa"), ("abc", "abcd"), ("😀b😀b", "😀b")]
    df = spark.createDataFrame(cases, "t string, p string")
    got = df.select("t", "p", text.spans(F.col("t"), F.col("p")).alias("s")).collect()
    for r in got:
        starts = [i for i in range(len(r.t)) if r.p and r.t.startswith(r.p, i)]
        assert [tuple(x) for x in r.s] == [(i, i + len(r.p)) for i in starts], (r.t, r.p)


def test_context_references(spark):
    policy = "# P\n## 2. Regulatory Context\n| SYSC 10.1.10R | **COCON** | PRIN 2A | PRIN 2A |\n## 3. Other\nCOBS 9"
    got = spark.range(1).select(text.context_references(F.lit(policy)), text.context_references(F.lit("none"))).first()
    assert got[0] == ["COCON", "PRIN 2A", "SYSC 10.1"] and got[1] == []


RAW = [
    ('[{"a": 1}]', 1), ('```json\n[{"a": 1}]\n```', 1), ('Here you go:\n[{"a": 1}, {"a": 2}]\nHope that helps.', 2),
    ("not json at all", 0), ('[{"element": "x", "status": "PRESENT"}, "junk", 42]', 1), ('{"a": [{"b": 1}]}', 0), ("", 0),
    ('```\n[{"a": 1}]', 1), ("[broken", 0),
]


def test_tolerant_json(spark):
    df = spark.createDataFrame(RAW, "raw string, n int")
    assert all(r[0] == r[1] for r in df.select("n", F.size(responses.json_items(F.col("raw")))).collect())


def test_json_document(spark):
    df = spark.createDataFrame([('x ```json\n{"v": "pass"}\n``` y',), ('so {"v": "pass"} ok',), ("none",)], "raw string")
    got = [r[0] for r in df.select(F.try_variant_get(responses.json_document(F.col("raw")), "$.v", "string")).collect()]
    assert got == ["pass", "pass", None]


def test_labels(spark):
    cases = [("present", "PRESENT"), ("Partial", "PARTIAL"), ("MISSING", "MISSING"), ("weird", "MISSING"), (" present ", "MISSING")]
    df = spark.createDataFrame(cases, "v string, want string")
    assert all(r[0] == r[1] for r in df.select("want", responses.status_label(F.col("v"))).collect())
    cases = [("grounded", "GROUNDED"), ("partially grounded", "PARTIALLY_GROUNDED"), ("nonsense", "UNGROUNDED")]
    df = spark.createDataFrame(cases, "v string, want string")
    assert all(r[0] == r[1] for r in df.select("want", responses.grounding_label(F.col("v"))).collect())
    df = spark.createDataFrame([(" customer_draft ",), ("both",)], "v string")
    assert [r[0] for r in df.select(responses.source_field_label(F.col("v"))).collect()] == ["customer_draft", "unknown"]


def test_claims_and_chunk_ids(spark):
    raw = (
        '[{"claim": "a", "source_field": "handler_answer", "grounding": "grounded", "supporting_chunk_id": ["s3://a", "s3://b"]},'
        ' {"supporting_chunk_id": []}, {"supporting_chunk_id": null}, {"supporting_chunk_id": "s3://c"}, {"supporting_chunk_id": 5}]'
    )
    got = spark.range(1).select(F.explode(responses.claims(F.lit(raw))).alias("c")).select("c.*").collect()
    assert [r.supporting_chunk_id for r in got] == ["s3://a", None, None, "s3://c", "5"]
    assert (got[0].claim, got[0].source_field, got[0].grounding) == ("a", "handler_answer", "GROUNDED")
    assert (got[1].source_field, got[1].grounding) == ("unknown", "UNGROUNDED")


def test_response_text(spark):
    block = "named_struct('type', cast(null as string), 'text', {t}, 'reasoningContent', named_struct('reasoningText', named_struct('text', {r})), 'other', {o})"
    def blocks(*items):
        return F.expr("array(" + ", ".join(block.format(t=t, r=r, o=o) for t, r, o in items) + ")")
    null = "cast(null as string)"
    row = spark.range(1).select(
        responses.response_text(blocks(("'hello'", null, null), ("'b'", "'r'", null))), responses.response_text(blocks((null, "'why'", null))),
        responses.response_text(blocks((null, null, "' [1]'"))), responses.response_text(blocks((null, null, "'x'"))),
    ).first()
    assert list(row) == ["hello\nb", "why", " [1]", ""]


def test_numbers(spark):
    row = spark.range(1).select(
        numbers.ratio(F.lit(1), F.lit(0)), numbers.ratio(F.lit(1), F.lit(4)), numbers.f1(F.lit(0.0), F.lit(0.0)), numbers.f1(F.lit(1.0), F.lit(0.5)),
        numbers.model_id(F.lit("haiku")), numbers.model_id(F.lit("other")),
        numbers.call_cost(numbers.model_id(F.lit("opus")), F.lit(2000), F.lit(500)), numbers.call_cost(F.lit("x"), F.lit(9), F.lit(9)),
        numbers.usage(F.expr("named_struct('inputTokens', 3, 'outputTokens', cast(null as int), 'totalTokens', 4)")),
    ).first()
    assert list(row)[:4] == pytest.approx([0.0, 0.25, 0.0, 2 / 3])
    assert row[4] == fixed.MODEL_PRESETS["haiku"] and row[5] == "other"
    assert row[6] == pytest.approx(0.0675) and row[7] == 0.0
    assert tuple(row[8]) == (3, 0, 4)


@pytest.mark.parametrize("key", [b"k", b"x" * 100])
def test_keyed_hash(spark, key):
    for message in ("", "héllo"):
        want = hmac.new(key, message.encode(), hashlib.sha256).hexdigest()
        assert spark.range(1).select(numbers.keyed_hash(F.lit(message), key)).first()[0] == want


def test_grounding_message_names_the_fields_claims_have_to_give(spark):
    from ragspark.functions import prompts
    row = spark.createDataFrame([("note", None, "ctx")], "h string, c string, x string")
    text = row.select(prompts.grounding_message(F.col("h"), F.col("c"), F.col("x"))).first()[0]
    assert "(source_field: handler_answer) ---\nnote\n" in text and "(source_field: customer_draft) ---\n(empty)\n" in text
    assert "source_field:" not in row.select(prompts.drafted_response(F.col("h"), F.col("c"))).first()[0]
