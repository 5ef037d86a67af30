"""Transformers on small frames: native against Arrow, nulls, sizes, structure, streams, SQL."""

import pytest
from pyspark.sql import functions as F

from maskwright.functions.patterns import PATTERNS
from maskwright.functions.text import detect_languages, languages_column, mask_column, mask_value
from maskwright.functions.validators import COLUMNS, PREDICATES, column
from maskwright.operators import evaluate, frames, models, native, risk, structured
from maskwright.operators.entities import Entity, match_patterns, merge
from maskwright.sources import tables
from maskwright.streaming.sessions import PROVIDER, SessionRedactor, redact_stream, split_at_boundary

TEXTS = [
    None, "", "plain", "😀 mail a.b@corp.test, card 4111 1111 1111 1111; call (212) 555-0187", "order # 4111111111111111", "x" * 50 + " 192.168.0.1", "DOB: 03/04/1990 passport no. A12345678", "version 1.2.3.4 and 10.0.0.1",
    "客户张明的手机13812345678，身份证110101199003074610", "护照号E12345678 QQ：123456789 微信号：abc_123456", "就职于北京天地科技有限公司", "HIV positive, salary of $5,000 and credit score 700", "I told my wife", "CPF 529.982.247-25 IBAN DE89370400440532013000",
]
VALUES = {
    "luhn": ["4111111111111111", "4111111111111112", "41111111"], "age": ["42 years old", "200岁", "x"], "email": ["a@b.co", "a..b@c.d", ".a@c.d"], "iban": ["DE89370400440532013000", "DE88370400440532013000", "XX1"],
    "jwt": ["eyJhbGciOiJIUzI1NiJ9.eyJhIjoxfQ.abc", "eyJub3RoaW5nIjoxfQ.eyJhIjoxfQ.abc"], "cn_id": ["110101199003074610", "110101 19900307 4610", "110101199003074611"], "hk_id": ["A123456(3)", "A123456(4)", "AB987654(3)"],
    "tw_id": ["A123456789", "A123456788"], "bank_card": ["6217001234567890123", "4111111111111111", "1234567890123456"], "credit_code": ["91350100M000100Y43", "91350100M000100Y44"], "organization": ["在公司", "天地公司", "在去天地集团"],
    "school": ["在大学", "北京大学"], "ssn": ["123-45-6789", "666-45-6789", "123 00 6789"], "jp_phone": ["090-1234-5678", "03-123"], "my_number": ["123456789018", "123456789012"], "de_tax_id": ["12 345 678 901", "02345678901"],
    "de_phone": ["+49 170 1234567", "0123"], "aadhaar": ["2345 6789 0123", "1345 6789 0123"], "pan": ["ABCPE1234F", "ABCDE1234F"], "cpf": ["529.982.247-25", "111.111.111-11"], "cnpj": ["11.222.333/0001-81", "11.222.333/0001-82"],
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").cache()


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_validator_columns(spark, name):
    rows = spark.createDataFrame([(v,) for v in VALUES[name]], "v string").select("v", column(name, F.col("v")).alias("ok")).collect()
    assert [(r.v, r.ok) for r in rows] == [(v, PREDICATES[name](v)) for v in VALUES[name]]


def test_native_spans_equal_arrow(docs):
    langs = ("en", "zh", "br")
    chosen = [p for p in PATTERNS if p.lang in ("shared", *langs)]
    for part in (chosen[i : i + 15] for i in range(0, len(chosen), 15)):
        rows = docs.where("text IS NOT NULL").select("text", *(native.pattern_entities(F.col("text"), p).alias(f"p{i}") for i, p in enumerate(part))).collect()
        for r in rows:
            found, _ = match_patterns(r.text, langs)
            for i, p in enumerate(part):
                mine = {(e.start, e.end, e.text, e.type) for e in r[f"p{i}"]}
                assert mine <= {(e.start, e.end, e.text, e.type) for e in found}, (p, r.text)
            assert sum(len(r[f"p{i}"]) for i in range(len(part))) <= len(found)


def test_native_merge_and_mask(docs):
    rows = native.mask_native(native.detect_native(docs, langs=("en",), types=("email", "credit_card", "phone", "ip_address"))).collect()
    by = {r.doc_id: r for r in rows}
    assert "a***@corp.test" in by[3].redacted and by[0].redacted is None and by[2].redacted == "plain"
    spans = [Entity(0, 3, "abc", "x", 0.5), Entity(2, 6, "cdef", "y"), Entity(7, 9, "hi", "x")]
    one = docs.limit(1).select(F.array(*(F.struct(F.lit(e.start).alias("start"), F.lit(e.end).alias("end"), F.lit(e.text).alias("text"), F.lit(e.type).alias("type"), F.lit(e.confidence).alias("confidence"), F.lit(1).alias("layer")) for e in spans)).alias("e"))
    assert [tuple(x) for x in one.select(native.merge_column(F.col("e")).alias("m")).first().m] == [tuple(e) for e in merge(spans, "abcdefghij")]


def test_language_and_mask_columns(docs):
    for r in docs.where("text IS NOT NULL").select("text", languages_column(F.col("text")).alias("l"), mask_column(F.col("text"), "email").alias("m"), mask_column(F.col("text"), "phone").alias("p")).collect():
        assert r.l == detect_languages(r.text) and r.m == mask_value(r.text, "email") and r.p == mask_value(r.text, "phone")


def test_detect_redact_restore(docs):
    r = frames.redact(docs, salt=7, lang=["en", "zh"], profile="gdpr", config={"self_reference": {"strategy": "remove"}})
    back = frames.restore_text(r.select("doc_id", "text", F.col("redacted.text").alias("red"), F.col("redacted.key").alias("key")), "red", "key").collect()
    assert all(x.restored == x.text for x in back) and back[0].red is None
    rows = {x.doc_id: x for x in frames.detect(docs, lang="auto").collect()}
    assert rows[0].detected is None and rows[1].detected.entities == [] and rows[8].detected.langs == ["zh"]
    with pytest.raises(ValueError):
        frames.detect(docs, types=["a"], types_exclude=["b"])
    big = frames.redact(docs.limit(1).select(F.repeat(F.lit("a"), (1 << 20) + 1).alias("text")), salt=1).first().redacted
    assert big.oversize and big.text is None


def test_three_forms(docs):
    r = frames.redact3(docs.where("doc_id IN (3, 8)"), salt="s", lang=["en", "zh"]).collect()
    assert "EMAI-" in r[0].forms.audit_text and "@example." in r[0].forms.downstream_text and "ⓕ" in r[0].forms.display_text
    dirty = docs.limit(1).select(F.lit("x@example.com").alias("text"))
    assert frames.redact3(dirty, salt=1).first().forms.polluted and not frames.redact3(dirty, salt=1, strict_input=False).first().forms.polluted


def test_models(docs):
    tag = models.tagger(lambda t: [(0, 5, "ORG")] if t.startswith("plain") else [])
    llm = models.language_model(lambda t: 'sure: [{"text": "plain", "type": "organization"}]')
    found = frames.detect(docs.where("doc_id = 2"), lang="en", mode="auto", models=((2, tag), (3, llm))).first().detected
    assert [(e.type, e.text) for e in found.entities] == [("organization", "plain")] and found.layer_status[3] == "ok" and found.entities[0].confidence > 0.85
    assert models.language_model(lambda t: "no json")("x") == []


def test_risk(spark):
    rows = [([("medical",), ("phone",), ("self_reference",), ("address",)],), ([("email",)],), ([],), (None,)]
    r = spark.createDataFrame(rows, "e array<struct<type:string>>").select(risk.assess_column(F.col("e"), "zh").alias("r")).collect()
    assert r[0].r.score == 1.0 and r[0].r.level == "critical" and "quasi-identifier combination: address + phone" in r[0].r.reasons and r[0].r.gdpr_special_category
    assert (r[1].r.score, r[1].r.level, r[1].r.hipaa_categories) == (0.5, "medium", ["email_addresses"]) and r[2].r.level == "none" and r[3].r is None
    assert r[0].r.pipl_articles == ["PIPL Art.13", "PIPL Art.28", "PIPL Art.51", "PIPL Art.29", "PIPL Art.55", "PIPL Art.56"]


def test_evaluation(spark):
    p = spark.createDataFrame([(1, "a", "x", 0, 4), (1, "a", "z", 20, 24)], "doc_id long, type string, text string, start int, end int")
    g = spark.createDataFrame([(1, "a", "x", 2, 5), (1, "a", "y", 40, 44)], p.schema)
    v, s = evaluate.match_values(p, g).first(), evaluate.match_spans(p, g).first()
    assert (v.tp, v.fp, v.fn) == (1, 1, 1) and (s.tp, s.fp, s.fn) == (1, 1, 1)


def test_structured(spark):
    df = spark.createDataFrame([('{"a": "x a.b@corp.test", "b": [{"c": "a.b@corp.test"}], "n": 3}',), ("no json",), (None,)], "j string")
    r = structured.redact_json(df, "j", salt=1, lang="en", paths=["b[*].c"]).collect()
    assert '"a": "x a.b@corp.test"' in r[0].redacted.json and '"c": "a***@corp.test"' in r[0].redacted.json and not r[1].redacted.valid and r[2].redacted is None
    csv = structured.redact_csv(spark.createDataFrame([("mail\na.b@corp.test\na.b@corp.test",)], "content string"), salt=1, lang="en").first().redacted
    assert csv.csv.splitlines()[0] == "mail" and len(csv.key) == 1
    nested = spark.sql("select named_struct('a', ' q ', 'b', array('w')) as s")
    assert nested.select(structured.map_leaves(nested.schema["s"].dataType, F.col("s"), F.upper, [("b", "*")]).alias("s")).first().s.asDict(True) == {"a": " q ", "b": ["W"]}


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("hello\nworld")
    assert tables.read_texts(spark, str(tmp_path / "in")).first().text == "hello\nworld"
    (tmp_path / "o.json").write_text('{"phone": {"strategy": "remove"}}')
    assert tables.load_options(str(tmp_path / "o.json"))["phone"]["strategy"] == "remove"
    r = frames.redact(spark.createDataFrame([(1, "a.b@corp.test")], "id long, text string"), salt=1, lang="en")
    tables.write_keys(r, str(tmp_path / "keys"), "id")
    assert list(tables.read_keys(spark, str(tmp_path / "keys"), "id").first().key.values()) == ["a.b@corp.test"]
    m = tables.RunMetrics("t")
    m.watch(r).write.format("noop").mode("overwrite").save()
    assert m.record()["entities"] == 1


def test_sessions_without_spark():
    assert split_at_boundary("a", "b. c") == ("ab.", " c") and split_at_boundary("", "x" * 5000)[1] == "" and split_at_boundary("", "x" * 5000, None)[0] == ""
    s = SessionRedactor(salt=3, lang="en")
    assert s.feed("mail ab@co") is None
    first = s.feed("rp.test. More")
    state = s.export()
    assert "salt" not in state and "@example." in first["downstream_text"]
    second = SessionRedactor(salt=3, lang="en", state=state).feed(" mail ab@corp.test again.")
    fake = next(iter(state["fakes"].values()))
    assert fake in second["downstream_text"] and "EMAI-" in second["audit_text"] and fake not in second["audit_text"]
    with pytest.raises(ValueError):
        SessionRedactor(salt=3, state={"version": 99})


def test_stream_equals_sessions(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = [("s1", 1, "Mail ab@co", False), ("s1", 2, "rp.test. Then call (212) 555", False), ("s2", 1, "nothing here", True), ("s1", 3, "-0187 or ab@corp.test", True)]
    for k, r in enumerate(rows):
        spark.createDataFrame([r], "session string, seq long, chunk string, is_last boolean").coalesce(1).write.json(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema("session string, seq long, chunk string, is_last boolean").option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
    q = redact_stream(stream, salt=3, lang="en").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect():
        got[r.session] = got.get(r.session, "") + r.downstream_text
    for name in ("s1", "s2"):
        one, text = SessionRedactor(salt=3, lang="en"), ""
        for _, _, chunk, last in (r for r in rows if r[0] == name):
            forms = one.feed(chunk, last)
            text += forms["downstream_text"] if forms else ""
        assert got[name] == text


def test_entry_and_sql(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(3).count() == 3
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and all(callable(f) for f in names.values())
