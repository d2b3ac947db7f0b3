import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seekspark.config import EngineConfig
from seekspark.operators.chunking import body_of_storage_text, chunk_files, embedding_text, storage_text
from seekspark.operators.lines import line_windows
from seekspark.operators.symbols import scan_json_keys

TS = """import x from 'y';
export class Foo {
  private a = 1;

  constructor(private x: number) {
    if (x) { y("}"); }
  }
  async run<T>(o: {a: 1}): Promise<void> {
    function inner() {}
  }
}
export function top(a) {
  return 1;
}
const arrow = () => 1;"""
RB = """module A
  class B
    attr :x
    def foo(x)
      if x
        y.each do |z|
          1
        end
      end
      return 3 if x
    end
    def self.bar; 1; end
  end
end"""
PY = """import a
@dec
class A:
    x = 1
    def f(self):
        return 1
    @property
    def p(self):
        return 1
async def top():
    pass"""


def windows_by_hand(text, size, overlap):
    lines, out, start = text.replace("\r\n", "\n").split("\n"), [], 0
    while True:
        end = min(start + size, len(lines))
        out.append((start + 1, end, "\n".join(lines[start:end])))
        if end >= len(lines):
            return out
        start += max(1, size - overlap)


def test_windows_equal_a_plain_loop(spark):
    random.seed(1)
    texts = ["", "a", "a\n", "\n\n", "a\r\nb"] + ["\n".join(str(random.random()) for _ in range(n)) for n in range(1, 40)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    for size, overlap in ((5, 2), (3, 0), (4, 9), (1, 1)):
        got = {}
        for r in line_windows(frame, size, overlap).orderBy("id", "ordinal").collect():
            got.setdefault(r.id, []).append((r.start_line, r.end_line, r.body))
        assert got == {i: windows_by_hand(t, size, overlap) for i, t in enumerate(texts)}


def chunks(spark, path, text, **options):
    rows = chunk_files(spark.createDataFrame([(path, text)], "path string, text string"), EngineConfig(**options)).orderBy("ordinal").collect()
    return [(r.start_line, r.end_line, r.symbol_name, r.definition_of, r.chunk_mode) for r in rows], rows


def test_symbols_follow_line_patterns(spark):
    got, _ = chunks(spark, "a.py", "x = (\ndef f():\n  pass\n")
    assert got == [(1, 1, None, None, "preamble"), (2, 4, "f", "f", "symbol")]


def test_config_sections_and_plain_text(spark):
    got, _ = chunks(spark, "c.yml", "# c\nx: 1\ny:\n  z: 2\ntest: 1", config_aware_chunking=True)
    assert got == [(2, 2, "x", "x", "symbol"), (3, 4, "y", "y", "symbol"), (5, 5, "test", "test", "symbol")]
    assert chunks(spark, "c.yml", "x: 1")[0] == [(1, 1, None, None, "fallback_lexical")]
    assert chunks(spark, "e.md", "")[0] == [(1, 1, None, None, "fallback_lexical")]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text("ab{}[]\"\\", min_size=1, max_size=4), st.text("ab{}\"\\,:", max_size=8), max_size=6))
def test_json_keys_of_pretty_documents(document):
    text = json.dumps({k: {"n": v} for k, v in document.items()}, indent=1)
    found = [k["key"] for k in scan_json_keys(text)]
    plain = [json.dumps(k)[1:-1] for k in document if '"' not in k and not k.endswith("\\")]
    assert [k for k in found if k in plain] == plain


def test_covered_chunks_hold_every_line_with_text(spark):
    for path, text in (("a.ts", TS), ("a.rb", RB), ("a.py", PY), ("a.go", "package a\n\nvar x = 1\nfunc f() {\n}\n// end\n")):
        got, _ = chunks(spark, path, text, chunk_lines=4)
        held = {n for s, e, *_ in got for n in range(s, e + 1)}
        assert all(i in held for i, line in enumerate(text.split("\n"), 1) if line.strip()), path


def test_storage_text_round_trip(spark):
    frame = spark.createDataFrame([("a/b-c.rb", "x\ny"), ("d", "")], "path string, body string")
    stored = storage_text(F.col("path"), F.col("body"))
    rows = frame.select("body", stored.alias("s"), body_of_storage_text(stored).alias("b")).collect()
    assert rows[0].s.startswith("a/b-c.rb b-c.rb b c.rb a b-c.rb\n") and all(r.b == r.body for r in rows)


def test_embedded_text_is_whole(spark):
    body = "word " * 5_000
    got = chunk_files(spark.createDataFrame([("a.md", body)], "path string, text string"), EngineConfig()).select(embedding_text().alias("t")).first().t
    assert got == "[path=a.md][lang=md]\n" + body
