"""Golden and derived vectors of the column functions. Golden ones are marked; the others follow from
published algorithms or from the behaviour that the docstrings state."""

import json
import unicodedata
import zlib

import pytest
from pyspark.sql import functions as F

from textloom.functions import bits, codec, hashing, jsonops, kv, misc, text, timeops, unicode, url


def one(spark, column, **values):
    """A column over one row of literals."""
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def rows(spark, column, values, kind="string"):
    table = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in table.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


#: Golden.
DOMAINS = [
    ("http://abcde.co.uk/", "abcde.co.uk"), ("http://ab.cde.co.uk/", "cde.co.uk"), ("http://www.baidu.com/", "baidu.com"),
    ("http://www.sina.com.cn/", "sina.com.cn"), ("http://cn/", None), ("http://com.cn/", None), ("http://xxx.com.cn/", "xxx.com.cn"),
    ("http://xxx.baidu.cc/", "baidu.cc"), ("http://xiechuyan.0739.cc/", "0739.cc"), ("http://city.kawasaki.jp/", "city.kawasaki.jp"),
    ("http://a.kawasaki.jp/", None), ("http://a.b.c..com.cn/", ".com.cn"), ("http://192.168.1.1/", None), ("http://192.168.1.acd/", "1.acd"),
    ("http://www.a/", "www.a"), ("http://www.qld.edu.au/", "www.qld.edu.au"), (None, None), ("", None),
]


def test_domains(spark):
    assert rows(spark, url.domain, [u for u, _ in DOMAINS]) == [d for _, d in DOMAINS]
    rules = spark.createDataFrame(list(url.RULES), "name string, type int")
    hosts = spark.createDataFrame([(u,) for u, _ in DOMAINS], "u string").select("u", url.host(F.col("u")).alias("h"))
    assert {r["u"]: r["domain"] for r in url.join_domains(hosts, "h", rules).collect()} == dict(DOMAINS)


def test_domain_rules_of_all_kinds(spark):
    """Rule set 1 of the tests: normal, wildcard and exception rules."""
    rules = (("jp", 0), ("ac.jp", 0), ("bar.jp", 2), ("baz.bar.jp", 2), ("pref.bar.jp", 1), ("bar.baz.com", 0), ("c", 2), ("b.c", 1))
    cases = {"a.baz.jp": "baz.jp", "ac.jp": None, "a.b.bar.jp": "a.b.bar.jp", "pref.bar.jp": "pref.bar.jp", "x.pref.bar.jp": "pref.bar.jp", "a.b.c": "b.c", "x.a.c": "x.a.c", "b.c": "b.c"}
    assert rows(spark, lambda x: url.domain_of_host(x, rules), list(cases)) == list(cases.values())


def test_url_parts(spark):
    got = one(spark, url.parts(F.lit("HTTP://me:pa:ss@WWW.a.b:8080/p/q?x=1&y#top")))
    assert got.asDict() == {"scheme": "http", "user": "me", "password": "pa:ss", "host": "www.a.b", "port": "8080", "path": "/p/q", "query": "x=1&y", "ref": "top"}
    assert set(one(spark, url.parts(F.lit("no url"))).asDict().values()) == {None}
    assert rows(spark, url.scheme, ["http://abcde.co.uk/", "https://abcde.co.uk/"]) == ["http", "https"]  # golden
    assert rows(spark, url.canonical, ["HTTP://A.b:80", "https://a.b:80/x?q#r", "x"]) == ["http://a.b/", "https://a.b:80/x?q#r", None]
    assert rows(spark, url.request, ["http://a?b=1", "http://a/c#d", None]) == ["/?b=1", "/c", None]
    assert rows(spark, url.host_is_ip, ["http://1.2.3.4/", "http://[::1]:80/", "http://1.2.3.400/", None]) == [True, True, False, False]
    assert rows(spark, url.is_host_page, ["http://a/", "http://a", "http://a/b", "http://a/?q=1"]) == [True, True, False, False]
    assert rows(spark, url.is_file, ["file:///etc", "http://a"]) == [True, False] and rows(spark, url.is_valid, ["file:///etc", "http:///x"]) == [True, False]
    assert one(spark, url.same_domain(F.lit("http://a.b.com/"), F.lit("https://c.b.com/x"))) is True
    assert one(spark, url.resolve(F.lit("http://a/b/c"), F.lit("../d"))) == "http://a/d"


def test_url_encoding(spark):
    assert rows(spark, url.url_encode, ["a b-_.!~*'()/?", "中"]) == ["a+b-_.!~*'()%2F%3F", "%E4%B8%AD"]
    assert rows(spark, url.url_decode, ["a+b%20c", "50%+%zz%20x", "%", "%4"]) == ["a b c", "50? ?zz x", "?", "?4"]


def test_fingerprint(spark):
    page = "http://app.kid.qq.com/exam/5528/5528_103392.htm"
    h = hashing.fingerprint(F.lit(page))
    assert one(spark, hashing.unsigned(h)) == "17105673616436300159"  # golden
    assert one(spark, hashing.fingerprint_to_string(h)) == "7F09753F868F63ED"  # golden
    assert one(spark, hashing.string_to_fingerprint(F.lit("7F09753F868F63ED"))) == "17105673616436300159"  # golden
    assert rows(spark, lambda x: hashing.unsigned(hashing.fingerprint(x)), ["", "a", "hello world", None]) == ["11072244398978028144", "1324337768545864161", "11367934579232745151", None]
    assert one(spark, hashing.string_to_fingerprint(F.lit("7F"))) is None


def test_other_hashes(spark):
    assert rows(spark, hashing.jenkins, ["a", "The quick brown fox jumps over the lazy dog", "", None]) == [0xCA2E9442, 0x519E91F5, 0, None]

    def plain(x):
        h = 0
        for b in x.encode():
            h = (h * 131 + (b - 256 if b > 127 else b)) % 2**64
        return h - 2**64 if h >= 2**63 else h

    texts = ["", "a", "中文 text", "x" * 100]
    assert rows(spark, hashing.times131, texts) == list(map(plain, texts))


def test_codecs(spark):
    assert one(spark, codec.base64_encode(F.lit("hello world").cast("binary"))) == "aGVsbG8gd29ybGQ="  # golden
    assert one(spark, codec.base64_decode(F.lit("aGVsbG8gd29ybGQ=")).cast("string")) == "hello world"  # golden
    assert "\n" not in one(spark, codec.base64_encode(F.lit("a" * 90).cast("binary")))
    assert rows(spark, codec.base64_decode, ["@@@@"]) == [None] and rows(spark, codec.hex_decode, ["zz"]) == [None]
    data = [b"", b"123456789", bytes(range(256)), None]
    assert rows(spark, codec.crc32c, data, "binary")[:2] == [0, 0xE3069283]
    assert rows(spark, codec.adler32, data, "binary") == [zlib.adler32(x) if x is not None else None for x in data]
    assert rows(spark, codec.crc32, data, "binary") == [zlib.crc32(x) if x is not None else None for x in data]
    assert one(spark, codec.html_escape(F.lit("<a href='x'>&\"</a>"))) == "&lt;a href=&#39;x&#39;&gt;&amp;&quot;&lt;/a&gt;"
    assert one(spark, codec.md5_of_parts(F.array(F.lit("ab"), F.lit("c")))) == "900150983cd24fb0d6963f7d28e17f72"


@pytest.mark.parametrize("n, low, high", [(0, -1, -1), (1, 0, 0), (2, 1, 1), (3, 1, 2), (4, 2, 2), (4294967295, 31, 32)])
def test_bits(spark, n, low, high):
    """Golden."""
    v = F.lit(n).cast("long")
    assert (one(spark, bits.log2_floor(v)), one(spark, bits.log2_ceiling(v))) == (low, high)


def test_bits_around_powers(spark):
    """Golden."""
    values = [2**i + d for i in range(3, 31) for d in (0, 1, 2, -1, -2)]
    assert rows(spark, bits.log2_floor, values, "long") == [i + (d < 0) * -1 for i in range(3, 31) for d in (0, 1, 2, -1, -2)]
    assert rows(spark, bits.log2_ceiling, values, "long") == [i + (d > 0) for i in range(3, 31) for d in (0, 1, 2, -1, -2)]
    assert rows(spark, bits.is_finite, [1.0, float("inf"), float("nan")], "double") == [True, False, False]


def test_byte_positions(spark):
    cases = [("abcd", "cd", 2), ("abcd", "x", -1), ("abc", "", 0), ("a中cd", "cd", 4)]
    assert [one(spark, text.byte_position(F.lit(t), p)) for t, p, _ in cases] == [n for *_, n in cases]


def test_text_functions(spark):
    assert rows(spark, text.ascii_lower, ["ÀB", None]) == ["Àb", None] and rows(spark, text.ascii_upper, ["àb"]) == ["àB"]
    assert rows(spark, lambda x: text.pieces(x, "|"), ["a||b", ""]) == [["a", "", "b"], [""]]
    assert rows(spark, lambda x: text.narrow(text.wide(x)), ["a中\U0001f600"]) == ["a中\U0001f600"]
    assert rows(spark, text.rune_text, [65, 0x4E2D, 0x1F600, -1, 0xD800], "int") == ["A", "中", "\U0001f600", "�", "�"]
    assert rows(spark, text.first_rune, ["中a", "", None]) == [0x4E2D, None, None]
    assert rows(spark, lambda x: text.compare(x, F.lit("abx"), 2), ["abc", "aa", "b"]) == [0, -1, 1]
    assert rows(spark, lambda x: text.starts_with(x, "Ab", False), ["aBc", "b"]) == [True, False]
    data = ["中文".encode("gb2312"), "中文".encode(), b"\xff\xfea\x00", b"plain", None]
    assert rows(spark, text.charset, data, "binary") == ["gb2312", "utf-8", "utf-16-le", "utf-8", None]
    assert one(spark, text.decoded(F.lit(bytearray("中".encode("gbk"))), F.lit("gbk"))) == "中"


def test_key_values(spark):
    cases = {
        "a=1&b=2": ([("a", "1"), ("b", "2")], True), "a==1": ([("a", "1")], True), "a=1&&a=2": ([("a", "1"), ("a", "2")], True),
        "a=": ([("a", "")], False), "a&b=2": ([("", ""), ("b", "2")], False), "": ([], True),
    }
    got = rows(spark, kv.key_value_pairs, list(cases))
    assert [([tuple(p) for p in g["pairs"]], g["ok"]) for g in got] == list(cases.values())
    assert one(spark, kv.first_wins(kv.key_value_pairs(F.lit("a=1&b=2&a=3"))["pairs"])) == {"a": "1", "b": "2"}


def test_escaped_maps(spark):
    m = F.create_map(F.lit("x,y"), F.lit("p:q"), F.lit("a"), F.lit("1\\"))
    assert one(spark, kv.map_to_string(m)) == "a:1\\\\,x\\,y:p\\:q"
    cases = {"a:1,b:2": {"a": "1", "b": "2"}, "x\\,y:p\\:q": {"x,y": "p:q"}, "a:1,": {"a": "1"}, "a:1,a:2": {"a": "1"}, "abc": None, "a:b\\q": None, "a:b\\": None, "": {}, ":": {"": ""}}
    assert rows(spark, kv.string_to_map, list(cases)) == list(cases.values())


def test_times(spark):
    assert rows(spark, timeops.in_days, [-1, 86_399_999_999, 86_400_000_000, -86_400_000_001], "long") == [0, 0, 1, -1]
    assert rows(spark, timeops.in_milliseconds_up, [1, 1000, 0], "long") == [1, 1, 0]
    assert rows(spark, lambda x: timeops.to_time_t(timeops.from_time_t(x)), [0, 12, -3], "long") == [0, 12, -3]
    assert rows(spark, lambda x: timeops.from_time_t(x).isNull(), [0, 1], "long") == [True, False]
    read = rows(spark, lambda x: timeops.to_time_t(timeops.from_string(x)), ["1970-01-02", "Fri, 02 Jan 1970 00:00:01", "01/02/1970", "nonsense", ""])
    assert read == [86400, 86401, 86400, 0, 0]
    assert one(spark, timeops.to_double_t(timeops.from_double_t(F.lit(1.5)))) == 1.5


PERSON = {
    "name": {"first_name": "Ye", "second_name": "Shunping"}, "age": 30, "address": "beijing",
    "phone_number": ["15100000000", "15100000001"], "address_id": 434798436777434024, "people_type": "HAN_ZU",
}


def test_messages(spark):
    read = jsonops.from_text(F.lit(json.dumps(PERSON)))
    assert json.loads(one(spark, jsonops.fast(read))) == PERSON
    assert json.loads(one(spark, jsonops.styled(read))) == PERSON
    assert json.loads(one(spark, jsonops.fast(jsonops.from_value(jsonops.to_value(read))))) == PERSON
    assert rows(spark, lambda x: jsonops.from_text(x).isNull(), ['{"age": 3}', "nonsense", '{"name": {}}', None]) == [True, True, False, True]


def test_flattening(spark):
    got = one(spark, jsonops.flattened(F.lit('{"b": [1, {"": null}], "a": "x"}')))
    assert [tuple(r) for r in got] == [(".", "{}"), (".a", '"x"'), (".b", "[]"), (".b[0]", "1"), (".b[1]", "{}"), (".b[1].", "null")]
    assert rows(spark, jsonops.flattened, ["{", None]) == [None, None]


def test_text_format(spark):
    message = 'name { first_name: "Ye" second_name: \'Shun\\"ping\' } # note\nage: 30 phone: "1" phone: "2" kind: HAN_ZU ok: true x < y: 1.5 >'
    assert json.loads(one(spark, jsonops.text_format(F.lit(message)))) == {
        "name": {"first_name": "Ye", "second_name": 'Shun"ping'}, "age": 30, "phone": ["1", "2"], "kind": "HAN_ZU", "ok": True, "x": {"y": 1.5},
    }
    assert rows(spark, jsonops.text_format, ["a {", "a: ", "a 1", None]) == [None] * 4


def test_templates(spark):
    made = misc.Template("{{! c }}<{{A:h}}|{{A:j}}|{{B:u}}>{{#S}}[{{X}}{{A}}]{{/S}}{{=<< >>=}}<<A>><<={{ }}=>>{{>I}}")
    out = made.render({"A": "<'>", "B": "a b&", "S": [{"X": 1}, {"X": 2, "A": "in"}]}, {"I": misc.Template("inc {{B}}")})
    assert out == "<&lt;&#39;&gt;|\\x3c\\x27\\x3e|a+b%26>[1<'>][2in]<'>inc a b&"
    with pytest.raises(ValueError):
        misc.Template("{{#A}}")
    assert misc.stripped("a \n\n b\n", "STRIP_WHITESPACE") == "ab" == one(spark, misc.strip_lines(F.lit("a \n\n b\n"), "STRIP_WHITESPACE"))
    assert misc.stripped("a\n \nb\n", "STRIP_BLANK_LINES") == "a\nb\n" == one(spark, misc.strip_lines(F.lit("a\n \nb\n"), "STRIP_BLANK_LINES"))
    assert rows(spark, lambda x: misc.autoescaped(x, "js_bare"), ["12.5", "alert()"]) == ["12.5", "null"]
    assert rows(spark, lambda x: misc.autoescaped(x, "url"), ["http://a?b&c", "javascript:x", "/rel"]) == ["http://a?b&amp;c", "#", "/rel"]


def test_conversion_lists_and_paths(spark):
    assert one(spark, misc.converted(F.lit("干什么"), [{"什么": "什麼", "什": "X"}, {"干": "幹"}])) == "幹什麼"
    assert rows(spark, misc.to_list, ["a", "", None]) == [["a"], [], []]
    assert one(spark, misc.relative_path(F.lit("a/B/c"), F.lit("A/b/d/e"))) == "../../c"
    assert one(spark, misc.relative_path(F.lit("a"), F.lit("a"))) == "."


def test_few_texts_are_strings_at_once(spark, monkeypatch):
    """A batch becomes Python strings in small parts, and texts of ASCII alone are not sent to Python."""
    monkeypatch.setattr(unicode, "AT_ONCE", 2)
    texts = ["é", None, "plain", "ñu", "", "ü", "ÀÉ"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    made = df.select(unicode.normalized(F.col("t"), "NFD").alias("t"))
    assert [r[0] for r in made.collect()] == [None if t is None else unicodedata.normalize("NFD", t) for t in texts]
    assert "octet_length(t" in made._jdf.queryExecution().optimizedPlan().toString()


def test_unicode(spark):
    apart = "Zürich ﬁn é"
    df = spark.createDataFrame([(apart,), ("plain",), ("",), (None,)], "t string")
    for form in unicode.FORMS:
        assert [r[0] for r in df.select(unicode.normalized(F.col("t"), form)).collect()] == [unicodedata.normalize(form, apart), "plain", "", None]
    assert [r[0] for r in df.select(unicode.without_marks(F.col("t"))).collect()] == ["Zurich ﬁn e", "plain", "", None]
    with pytest.raises(ValueError):
        unicode.normalized(F.col("t"), "NFX")
    assert df.select(unicode.collated(F.lit("STRASSE")) == unicode.collated(F.lit("strasse"))).first()[0]
    said = spark.createDataFrame([("One, two. Three!",), ("",), (None,)], "t string")
    assert [r[0] for r in said.select(unicode.sentences(F.col("t"), "en", "US")).collect()] == [[["One", "two"], ["Three"]], [], None]
    assert [r[0] for r in said.select(unicode.words(F.col("t"))).collect()] == [["One", "two", "Three"], [], None]


def test_rules_from_a_file(spark, tmp_path):
    path = tmp_path / "rules.dat"
    path.write_text("// a comment\n\ncom\njp  // more\n*.kawasaki.jp\n!city.kawasaki.jp\ncom\n")
    rules = url.read_rules(spark, str(path))
    assert sorted(map(tuple, rules.collect())) == [("city.kawasaki.jp", 1), ("com", 0), ("jp", 0), ("kawasaki.jp", 2)]
    hosts = spark.createDataFrame([("a.b.com",), ("x.city.kawasaki.jp",), ("x.y.z.kawasaki.jp",), (None,)], "h string")
    found = {r["h"]: r["domain"] for r in url.join_domains(hosts, "h", rules).collect()}
    assert found == {"a.b.com": "b.com", "x.city.kawasaki.jp": "city.kawasaki.jp", "x.y.z.kawasaki.jp": "y.z.kawasaki.jp", None: None}
