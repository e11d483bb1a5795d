import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from caseloom.functions import data, dates, documents, text


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize("f,arg,want", [
    (text.blank_to_null, " \t ", None), (text.blank_to_null, "  a ", "a"), (text.email_key, " A@B.C ", "a@b.c"), (text.digits, "+1 (2)", "12"),
    (text.is_email, "a@b.c", True), (text.is_email, "a b@c.d", False), (text.is_colour, "#12abEF", True), (text.is_phone, "+20 100 200 3000", True), (text.is_phone, "123", False),
    (text.video_id, "https://youtube.com/watch?v=abc_DEF-123&t=1", "abc_DEF-123"), (text.video_id, "https://x.org/watch?v=abc_DEF-123", ""), (text.video_id, "https://www.youtube.com/shorts/abc_DEF-123", "abc_DEF-123"), (text.video_id, "https://youtu.be/short", ""),
    (text.is_video, "ftp://evil.example/?v=abcdefghijk", False), (text.is_video, "https://www.youtube.com/x", True), (text.is_video, "http://youtu.be/abcdefghijk", False), (text.filled_lines, "a\r\n\r\n\t\nb", ["a\r", "b"]), (text.names, "A,\tb\r", ["a", "b"]), (text.safe_name, "a/b  c?.pdf", "a_b_c_.pdf"), (text.in_fours, "ABCDEFGHI", "ABCD EFGH I"),
    (text.first_hop, " 1.1.1.1, ,2.2.2.2,", "1.1.1.1"), (text.last_hop, " 1.1.1.1, ,2.2.2.2,", "2.2.2.2"), (text.last_hop, " , ", None), (text.extension, "a.b.Pdf", "PDF"),
    (text.no_query, "http://a/b?c=d", "http://a/b"), (text.filled_lines, "a\n \nb", ["a", "b"]), (text.names, " A, ,b", ["a", "b"]),
    (dates.size_text, 1023, "1023 B"), (dates.size_text, 1536, "2 KB"), (dates.size_text, 1572864, "1.5 MB"), (dates.h_mm, 125, "2:05"), (dates.hh_mm_ss, 3661, "01:01:01"), (dates.half_up, -2.5, -2),
    (data.text_list, '["a","b"]', ["a", "b"]), (data.text_list, '["a",null]', None), (data.text_list, "{", None), (data.summary, '{"a":"1","b":"2","c":"3","d":"4"}', "a=1, b=2, c=3"), (data.summary, '{"a":"1","status":"S"}', "S"),
])
def test_plain(spark, f, arg, want):
    assert one(spark, f(F.lit(arg))) == want


def test_scrub_order_and_cut(spark):
    s = "mail a.b@c.org Bearer abcdef123456 and " + "0" * 64 + " eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeKK"
    got = one(spark, text.scrub(F.lit(s)))
    assert "c.org" not in got and "abcdef123456" not in got and "0000" not in got and "[redacted-token]" in got and "Bearer [redacted-token]" in got and "[redacted-hex]" in got and "[redacted-email]" in got
    assert one(spark, text.scrub(F.lit("x " * 2500))).endswith("…[+3000 chars]")


def test_escape_is_not_doubled(spark):
    assert one(spark, text.escape_html(F.lit("<a & 'b'>\n"), True)) == "&lt;a &amp; &#39;b&#39;&gt;<br>"


def test_quotes_must_be_verbatim(spark):
    assert one(spark, text.quoted_only(F.array(F.lit("bc"), F.lit("zz")), F.lit("abcd"))) == ["bc", ""]


def test_template_and_labels(spark):
    assert one(spark, text.filled("To {who}: {what}", who=F.lit(" "), what=F.lit("x"))) == "To ........: x"
    assert one(spark, text.label(F.lit("k"), {"k": "Key"})) == "Key" and one(spark, text.label(F.lit("z"), {"k": "Key"})) == "z"
    assert one(spark, text.padded(F.lit(12345), 3)) == "12345" and one(spark, text.padded(F.lit(7), 3)) == "007"


def test_paths():
    assert text.inside("a/../b", "/r") and not text.inside("../x", "/r") and not text.inside("/etc/passwd", "/r") and not text.inside("../rr", "/r")


@pytest.mark.parametrize("left,right,want", [
    (["a", "b"], ["a", "b"], [("same", "a"), ("same", "b")]), ([], ["x"], [("add", "x")]), (["x"], [], [("del", "x")]),
    (["a", "b"], ["b", "a"], [("del", "a"), ("same", "b"), ("add", "a")]), (["a"], ["b"], [("del", "a"), ("add", "b")]),
])
def test_diff(left, right, want):
    assert documents.diff_lines(left, right) == want


def test_diff_rebuilds_both_sides(spark):
    a, b = "one\n\ntwo\nthree", "zero\ntwo\nthree\nfour"
    rows = one(spark, documents.diff(F.lit(a), F.lit(b)))
    assert [r["text"] for r in rows if r["kind"] != "add"] == ["one", "two", "three"]
    assert [r["text"] for r in rows if r["kind"] != "del"] == ["zero", "two", "three", "four"]


def test_extraction(spark):
    page = "<html><head><title>t</title></head><body><script>x()</script><p>Hi &amp; bye</p><p>2</p></body></html>"
    assert one(spark, documents.extract(F.lit("html"), F.lit(page))) == ("Hi & bye\n2", "html")
    assert one(spark, documents.extract(F.lit("pdf"), F.lit("%PDF")))["method"] == "unavailable"
    assert one(spark, documents.extract(F.lit("xls"), F.lit("x")))["method"] == "refused"


def test_review_shape(spark):
    ok = '{"summary":"s","parties":["a"],"risks":[{"level":"low","text":"t"}]}'
    assert [one(spark, data.valid_review(F.lit(x))) for x in (ok, ok.replace("low", "odd"), '{"summary":"s"}', "{", None)] == [True, False, False, False, False]


def test_digests_and_codecs(spark):
    assert one(spark, data.untampered(data.sha256(F.lit("a")), F.lit("a"))) is True
    assert one(spark, data.untampered(data.sha256(F.lit("a")), F.lit(None).cast("string"))) is None
    assert one(spark, data.from_base64url(data.to_base64url(F.lit("a?>~b"))).cast("string")) == "a?>~b"
    sig = hmac.new(b"k", b"body", hashlib.sha256).hexdigest()
    assert one(spark, data.signed(F.lit("body"), F.lit(sig), "k")) is True and one(spark, data.signed(F.lit("body"), F.lit("0"), "k")) is False


@pytest.mark.parametrize("kind,body,want", [("PDF", b"%PDF-1", True), ("PNG", b"\x89PNG..", True), ("TXT", b"plain", True), ("TXT", b"%PDF-1", True), ("TXT", b"a\x00b", False), ("TXT", b"x" * 1024 + b"\x00", True), ("XLSX", b"PK", True), ("DOC", b"\xd0\xcf\x11\xe0", False), ("EXE", b"MZ", False)])
def test_magic(spark, kind, body, want):
    assert one(spark, data.signature_fits(F.lit(kind), F.lit(body))) is want


def test_json_scrub_depth(spark):
    deep = '{"a":' * 9 + '"x"' + "}" * 9
    assert "[max-depth]" in one(spark, data.scrub_json(F.lit(deep)))
    assert one(spark, data.scrub_json(F.lit('{"Password":"p","m":"a@b.co"}'))) == '{"Password":"p","m":"[redacted-email]"}'
    assert one(spark, data.scrub_json(F.lit("{"))) is None


def test_changed_and_known(spark):
    got = data.supplied(F.create_map(F.lit("b"), F.lit(2), F.lit("z"), F.lit(1)), ["a", "b"])
    assert one(spark, got) == ["b"]
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in (("a", 1), ("b", 2), ("a", 3))])
    assert one(spark, data.entries_map(entries)) == {"a": "3", "b": "2"}


def test_event_scrub(spark):
    event = '{"user":{"id":1},"message":"a@b.co","request":{"url":"/x?token=1","data":"secret","headers":{"cookie":"c","host":"h"},"query_string":"q=1"},"breadcrumbs":[{"message":"Bearer abc","data":{"k":"a@b.co"}}],"exception":{"values":[{"value":"' + "f" * 40 + '"}]}}'
    got = one(spark, data.scrub_event(F.lit(event)))
    assert got == '{"message":"[redacted-email]","request":{"url":"/x","headers":{"host":"h"},"query_string":""},"breadcrumbs":[{"message":"Bearer [redacted-token]","data":{"k":"[redacted-email]"}}],"exception":{"values":[{"value":"[redacted-hex]"}]}}'
    assert one(spark, data.scrub_event(F.lit("[]"))) is None

    assert one(spark, data.known_keys(F.create_map(F.lit("a"), F.lit(1), F.lit("z"), F.lit(2)), ["a"])) == {"a": 1}


def test_diff_keeps_the_tie_rule():
    import random

    from caseloom.functions.documents import diff_lines

    def table(left, right):
        best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
        for i, x in enumerate(left):
            for j, y in enumerate(right):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        out, i, j = [], len(left), len(right)
        while i or j:
            if i and j and left[i - 1] == right[j - 1]:
                i, j = i - 1, j - 1
                out.append(("same", left[i]))
            elif j and (not i or best[i][j - 1] >= best[i - 1][j]):
                j -= 1
                out.append(("add", right[j]))
            else:
                i -= 1
                out.append(("del", left[i]))
        return out[::-1]

    rng = random.Random(1)
    for _ in range(300):
        a, b = [[rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(2)]
        assert diff_lines(a, b) == table(a, b)
    # however few rows are kept
    from caseloom.functions import documents as d

    kept, d.KEPT, places, d.PLACES = d.KEPT, 0, d.PLACES, 3
    for _ in range(300):
        a, b = [[rng.choice("abcd") for _ in range(rng.randint(0, 40))] for _ in range(2)]
        assert diff_lines(a, b) == table(a, b)
    d.KEPT, d.PLACES = kept, places


def test_diff_of_long_texts_takes_bounded_memory():
    import random
    import tracemalloc

    rng = random.Random(2)
    left = [f"line {rng.randrange(150_000)}" if rng.random() < 0.7 else rng.choice("abcde") for _ in range(200_000)]
    right = [x for x in left if rng.random() < 0.9]
    for _ in range(8000):
        right[rng.randrange(len(right))] = f"new {rng.random()}"
    tracemalloc.start()
    counts = {"same": 0, "add": 0, "del": 0}
    i, j = len(left), len(right)
    for kind, line in documents.diff_backwards(left, right):
        i, j = i - (kind != "add"), j - (kind != "del")
        assert (kind == "add" or left[i] == line) and (kind == "del" or right[j] == line)
        counts[kind] += 1
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert i == j == 0 and counts["same"] >= 170_000 and most < 200 << 20


def test_line_diffs_as_rows(spark):
    d = spark.createDataFrame([(1, "a\n\nb\nc", "b\nd"), (2, None, "x"), (3, None, None)], "id int, a string, b string")
    got = documents.line_diffs(d, "a", "b").orderBy("id", F.desc("back")).collect()
    assert [(r["id"], r["kind"], r["line"]) for r in got] == [(1, "del", "a"), (1, "same", "b"), (1, "del", "c"), (1, "add", "d"), (2, "add", "x")]


def test_docx(spark):
    import io
    import zipfile

    from caseloom.functions import docx

    made = docx.document(["One & <two>\tthree", "", "é \x00ش"])
    assert docx.text(made) == "One & <two>\tthree\n\n\n\né ش\n\n"

    def packed(xml, name=docx.PART):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(name, xml)
        return out.getvalue()

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>"
    odd = f"<w:p><w:pPr><w:tabs><w:tab/></w:tabs></w:pPr><w:del><w:r><w:delText>gone</w:delText></w:r></w:del><mc:AlternateContent><mc:Choice>{p('no')}</mc:Choice><mc:Fallback><w:r><w:t>yes</w:t></w:r></mc:Fallback></mc:AlternateContent></w:p>"
    assert docx.text(packed(f"<w:document {w}><w:body>{table}{odd}</w:body></w:document>")) == "a\n\nb\n\nyes\n\n"
    bomb = '<!DOCTYPE x [<!ENTITY a "aaaa"><!ENTITY b "&a;&a;&a;">]>' + f"<w:document {w}>&b;</w:document>"
    for torn in (b"", b"PK", made[:-30], made[: len(made) // 2], packed("<w:p>"), packed("<a/>", "other.xml"), packed(bomb)):
        with pytest.raises(ValueError):
            docx.text(torn)
    with pytest.raises(docx.Oversized):
        docx.text(docx.document(["a" * 100_000]), most=50_000)
    bodies = [("docx", docx.document(["long enough to be a text", "more"])), ("DOCX", docx.document(["short"])), ("docx", b"PK torn"), ("docx", None), ("txt", b" plain text of some length \n"), ("txt", b""), ("xlsx", b"x"), ("odd", b"x")]
    got = spark.createDataFrame(bodies, "k string, b binary").select(documents.extract(F.col("k"), F.col("b")).alias("x")).collect()
    assert [tuple(r["x"]) for r in got] == [("long enough to be a text\n\nmore", "docx"), (None, "too_little"), (None, "unreadable"), (None, "unreadable"), ("plain text of some length", "plain-text"), (None, "too_little"), (None, "refused"), (None, "refused")]


def test_made_files_are_handed_on_in_pieces(spark):
    import pyarrow as pa

    from caseloom.functions import docx

    taken = []
    rows = ((pa.scalar(i),) for i in range(1000) if taken.append(i) is None)
    pieces = documents._pieces(rows, lambda i: b"x" * 10_000, len, pa.binary())
    first = len(next(pieces))
    assert first == len(taken) < 200  # (a piece, not the batch, is held)
    assert first + sum(map(len, pieces)) == 1000
    texts = [None if i % 7 == 0 else f"line {i} " * (i % 40 * 40) + "\ntwo" for i in range(900)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(2)
    got = d.select("i", documents.extract(F.lit("docx"), documents.as_docx(F.split("t", "\n"))).alias("x")).collect()
    want = {i: documents._extracted("docx", None if t is None else docx.document(t.split("\n"))) for i, t in enumerate(texts)}
    assert {r["i"]: tuple(r["x"]) for r in got} == want


def test_pages_of_a_batch_are_not_held(spark):
    from pyspark.util import PythonEvalType

    pages = [None if i % 50 == 0 else f"<p>{'word &amp; ' * (i % 30 * 100)}</p><script>x</script>{i}" for i in range(600)]
    x = documents.extract(F.lit("HTML"), F.col("html"))
    d = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string").coalesce(1)
    got = d.select("i", x.alias("x")).collect()
    assert {r["i"]: tuple(r["x"]) for r in got} == {i: (documents.html_text(p or ""), "html") for i, p in enumerate(pages)}
    assert one(spark, documents.extract(F.lit(None).cast("string"), F.lit("x")))["method"] == "refused"
    # a function from batches to pieces: one of whole batches holds all their texts
    kinds = [n.udfs().head().evalType() for n in [d.select(x)._jdf.queryExecution().optimizedPlan().children().head()] if "EvalPython" in n.nodeName()]
    assert kinds == [PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF]


def test_a_large_page_is_held_a_few_times(spark):
    import tracemalloc

    page = ("<p>" + "word &amp; Größe " * 30 + "</p><script>x</script>\n") * 4000
    raw = page.encode()
    tracemalloc.start()
    text, _ = documents._extracted("html", raw)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert text == "\n".join(["word & Größe " * 29 + "word & Größe"] * 4000) and most < 4 * len(raw)
    # entities make lines and blanks as before: each line is unescaped by itself
    assert documents.html_text("<p>a&#10;&nbsp;b &am\np;</p>\n \n&NewLine;c&lt;i>\r\n<scr\nipt>d") == "a\nb &am\np;\nc<i>\nd"
    # a text that is torn inside a character is read like a file's bytes
    torn = spark.sql("SELECT CAST(X'3C703E61FF62C33C2F703E' AS STRING) AS html").select(documents.extract(F.lit("html"), F.col("html")).alias("x"))
    assert tuple(torn.first()["x"]) == ("a�b�", "html")
