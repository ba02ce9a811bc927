"""Mail archives made here: decoding, sanitizing, assets, tables."""

import base64
import quopri

import pytest
from quirespark.functions import codecs
from quirespark.plans import html as plan
from quirespark.sources import mail

PNG = b"\x89PNG fake"
BODY = """<html><body onload="x()"><!--[if mso]><p>only office</p><![endif]--><!--[if !mso]><!--><p>revealed text</p><!--<![endif]-->
<script>alert(1)</script><p>您好 <b>Bold</b> <a href="http://example.com/a">link</a><o:p></o:p></p><img src="cid:pic1"><img src="http://track.example.com/p.gif?u=1" width="1">
<table><tr><td><table><tr><th>k</th><th>v</th></tr><tr><td>a</td><td>1</td></tr><tr><td>b</td><td>2</td></tr></table></td></tr></table><div style="background:url(https://x.example.com/b.png)">end</div></body></html>"""


def mht() -> bytes:
    html = quopri.encodestring(BODY.encode("gb2312"))
    return (
        b"From: =?utf-8?B?" + base64.b64encode("张三".encode()) + b"?= <a@example.com>\r\nSubject: =?utf-8?Q?Caf=C3=A9_news?=\r\nMIME-Version: 1.0\r\nContent-Type: multipart/related; boundary=\"B\"\r\n\r\n"
        b"--B\r\nContent-Type: text/html; charset=gb2312\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\n" + html + b"\r\n--B\r\nContent-Type: image/png\r\nContent-ID: <pic1>\r\nContent-Location: img/a.png\r\nContent-Transfer-Encoding: base64\r\n\r\n" + base64.b64encode(PNG) + b"\r\n--B--\r\n"
    )


def test_codecs():
    assert codecs.decode_words("=?utf-8?Q?a_b=C3=A9?= x") == "a bé x"
    assert codecs.quoted_printable(b"ab=\r\ncd") == b"abcd" and codecs.quoted_printable(b"a=41b") == b"aAb"
    assert codecs.unpredict(bytes([2, 1, 2, 2, 1, 1]), 12, columns=2) == bytes([1, 2, 2, 3])
    assert codecs.run_length(bytes([2, 65, 66, 67, 254, 88, 128])) == b"ABCXXX"
    key = codecs.key_of_empty_password(3, bytes(32), -4, b"id", 128, True)
    assert len(key) == 16 and codecs.rc4(b"Wiki", b"pedia").hex() == "1021bf0420"
    assert codecs.aes_cbc_decrypt(bytes(32), bytes(16) + codecs.aes_cbc_encrypt(bytes(32), bytes(16), b"hello" + bytes([11]) * 11)) == b"hello"


@pytest.fixture(scope="module")
def read(spark):
    return mail.mails(spark.createDataFrame([("m", mht()), ("t", b"plain <text"), ("e", b""), ("n", None)], "doc_id string, content binary"))


def test_mail(read):
    rows = {r.doc_id: r for r in read.collect()}
    m = rows["m"]
    assert (m.subject, m.sender) == ("Café news", "张三 <a@example.com>") and "您好" in m.html
    assert {a.key for a in m.assets} == {"cid:pic1", "img/a.png", "a.png"}
    assert rows["e"].html == "<pre></pre>" and rows["n"].html == "<pre></pre>"


def test_text(spark, read):
    from pyspark.sql import functions as F

    pages = read.select("doc_id", "html", "subject", "sender")
    assets = read.select("doc_id", F.explode("assets").alias("a")).select("doc_id", "a.key", "a.data_url")
    text = {r.doc_id: r.text for r in plan.document_text(pages, assets).collect()}["m"]
    assert "revealed text" in text and "only office" not in text and "alert" not in text and "track.example" not in text and "x.example" not in text
    assert '"Bold" 粗体' in text and "链接 http://example.com/a" in text and "已阻止外部资源: 1" in text
    assert text.count("表格 [") == 1 and '  第2行: "a" | "1"' in text
