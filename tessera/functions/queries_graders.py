"""Queries of the answer parsers and graders, over replies made from every document's whole text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import choices as H
from tessera.functions import latex as L
from tessera.functions import text as X
from tessera.plans.registry import query

c = F.col


def _quoted(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def cases(name: str, rows: list[tuple], build, kind: str = "VARCHAR", noise: str = "") -> None:
    """Replies made from each document's whole text: its length picks a row of templates, @ is the length and § the text itself.

    ``noise`` puts the whole text before or after the first template, too.  The last template
    of a row is the value expected, of which the SQL makes the result.
    """
    *inputs, wants = zip(*rows)
    made = f"replace(replace(list_extract({_quoted(wants)}, (n % {len(rows)} + 1)::INT), '@', n::VARCHAR), '§', text)"
    sql = f"SELECT doc_id, CAST({made} AS {kind}) AS value FROM (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents)"

    def run(t):
        docs = t.documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("n", F.length("text"))
        pick = lambda xs: F.replace(F.replace(F.get(F.array(*map(F.lit, xs)), (c("n") % len(rows)).cast("int")), F.lit("@"), c("n").cast("string")), F.lit("§"), c("text"))
        first = lambda x: F.concat("text", F.lit("\n"), x) if noise == "before" else F.concat(x, F.lit("\n"), "text") if noise == "after" else x
        docs = X.staged(docs, {f"x{i}": first(pick(xs)) if i == 0 else pick(xs) for i, xs in enumerate(inputs)})
        value = build(*(c(f"x{i}") for i in range(len(inputs))))
        return docs.select("doc_id", (value.cast("string") if kind == "VARCHAR" else value).alias("value"))

    query(name, sql)(run)


TEXTS = ("red fox", "blue jay", "green frog", "black cat")


def letters():
    return F.split(F.lit("A,B,C,D"), ",")


def options():
    return F.array(*map(F.lit, TEXTS))


cases(
    "f4_answer_fallback",
    [("a <answer>@</answer> \\boxed{7}", "@"), ("so \\boxed{1} then \\boxed{x@}", "x@"), ("the total\nis 12.5 .\n", "12.5"), ("it is @.\nno number here", "@"), ("nothing", ""), ("<answer></answer> 9", "")],
    H.fallback_answer,
)
cases("f7_remove_boxed", [("\\boxed{§}", "§"), ("\\boxed 3@", "3@"), ("\\boxed{\\frac{1}{@}}", "\\frac{1}{@}"), ("\\boxed{}", "")], L.unboxed)
cases(
    "f11_letter",
    [("The best answer is (C) @", "C"), ("  B", "B"), ("The answer: none of these words have any of the needed capital letters at all", ""), ("The correct answer is D.", "D"), ("nothing @", ""), ("Answer is C", "A")],
    H.first_letter,
)
cases(
    "f12_parse_choice",
    [
        ("The answer is B @", "B"), ("(C) because of @", "C"), ("  A. first @", "A"), ("option D", "D"), ("it must be E) @ or so", "E"), ("", ""), ("maybe G= @ here", "G"), ("no letter", ""),
        ("3. C holds @", "C"), ("look at F: @ and C: @", "F"), ("'H'", "H"),
    ],
    H.parse_choice,
)
cases(
    "f13_parse_brackets",
    [("it is (B) or (D) @", "D"), ("I take C !", "C"), ("so A. is the one, not B. here", "A"), ("the animal must be the green frog @", "C"), ("a blue jay", "null"), ("first A then B @", "B"), ("not a red fox but a black cat @", "D")],
    lambda x: F.coalesce(H.parse_brackets(x, letters(), options()), F.lit("null")),
)
cases("f14_parse_open", [("The answer is @.", "#@.0"), ("x = 1,234", "#1234.0;#234.0"), ("so y\nthus Z", " y; z;y ;z "), ("blue", "blue")], lambda x: F.array_join(H.parse_open(x), ";"))
cases(
    "f16_option_texts",
    [("Which?\n(A) 16@\n(B) 13\n(C) 9\n(D) 1", "16@|13|9|1"), ("(A) one line\nand more\n(B)  two ", "one line\nand more|two"), ("no options", "")],
    lambda x: F.array_join(H.option_texts(x), "|"),
)
cases(
    "f20_crop_interval",
    [
        ("<tool_call>{'name': 'crop_video', 'arguments': {'start_time': 1, 'end_time': 2.5}}</tool_call>", "1.0-2.5"),
        ("<tool_call>{\"name\": \"crop_video\", \"arguments\": {\"start_time\": 3, \"end_time\": 4}}</tool_call> <tool_call>{'name': 'other', 'arguments': {'start_time': 8, 'end_time': 9}}</tool_call>", "3.0-4.0"),
        ("<tool_call>{'name': 'crop_video', 'arguments': {'start_time': 5, 'end_time': 6}}</tool_call><tool_call>not a call</tool_call><tool_call>{'name': 'crop_video', 'arguments': {'start_time': 7}}</tool_call>", "5.0-6.0"),
        ("no call @", ""),
    ],
    lambda x: F.coalesce(F.concat_ws("-", H.crop_interval(x)["start"].cast("string"), H.crop_interval(x)["end"].cast("string")), F.lit("")), noise="before",
)
cases(
    "f21_trace_messages",
    [
        ("try <code>```python\nprint(@)\n```</code><interpreter> @ </interpreter>so <answer>\\boxed{@}</answer>", "assistant:try:print(@)|tool:@:|assistant:so \\boxed{@}:"),
        ("<answer>§ @</answer>", "assistant:§ @:"),
        ("a<code>x=1</code><interpreter></interpreter> b <code>y=2</code><interpreter>ok</interpreter><answer>z</answer>", "assistant:a:x=1|tool::|assistant:b:y=2|tool:ok:|assistant:z:"),
    ],
    lambda x: F.array_join(F.transform(H.trace_messages(x), lambda m: F.concat(m["role"], F.lit(":"), m["content"], F.lit(":"), F.coalesce(m["code"], F.lit("")))), "|"),
)
cases(
    "f22_event_line",
    [("Video_event 1, 2 [0.0s \u2013 12.5s]: a dog @", "1, 2/0.0/12.5/a dog @"), ("Video_event 7 [ 3s - 4s] : x", "7/3.0/4.0/x"), ("Video event 7 [3s - 4s]: x", ""), ("Video_event 9 [3s - 4]: x", "")],
    lambda x: F.coalesce(F.concat_ws("/", H.event_line(x)["ids"], H.event_line(x)["start"].cast("string"), H.event_line(x)["end"].cast("string"), H.event_line(x)["text"]), F.lit("")),
)
cases(
    "t2_sorted_lines",
    [("Video_event b [10s - 12s]: later\nnoise\n Video_event a [2s - 3s]: first @\nVideo_event c [2s \u2013 2.55s]: short", "Video_event c [2.0s \u2013 2.6s]: short|Video_event a [2.0s \u2013 3.0s]: first @|Video_event b [10.0s \u2013 12.0s]: later"), ("none", "")],
    lambda x: F.array_join(H.sorted_event_lines(x), "|"),
)
cases("f26_passages", [("Title @\nline one\nline two;Other", "Doc 1 (Title: Title @)\nline one\nline two\n\nDoc 2 (Title: Other)"), ("Only\nx", "Doc 1 (Title: Only)\nx")], lambda x: H.passages(F.split(x, ";")))
cases("f28_print_last_line", [("a = @\na + 1\n\n", "a = @\nprint(a + 1)\n\n"), ("print(@)", "print(@)"), ("x", "print(x)"), ("f(1)\n  y", "f(1)\nprint(  y)")], H.print_last_line)
cases(
    "f32_tagged_match",
    [("<answer>The Fox!</answer>", "1.0"), ("<answer>dog</answer>", "0.1"), ("none", "0.0"), ("<answer>x</answer><answer> a fox</answer>", "1.0"), ("<answer>" * 11 + "fox</answer>", "0.1"), ("<answer>1</answer>" * 11 + "<answer>fox</answer>", "0.25")],
    lambda x: H.tagged_exact_match(x, F.array(F.lit("fox"), F.lit("wolf")), 0.1),
    "DOUBLE", noise="before",
)
cases(
    "f35_canonical",
    [
        ("\\frac12", "\\frac{1}{2}"), ("\\dfrac1{@}", "\\frac{1}{@}"), ("0.5", "\\frac{1}{2}"), (".5", "\\frac{1}{2}"), ("3/4", "\\frac{3}{4}"), ("x = @", "@"), ("\\sqrt3 + 1", "\\sqrt{3}+1"), ("12\\text{ cm}", "12"), ("50\\%", "50"),
        ("90^\\circ", "90"), ("\\left( 1, 2 \\right)", "(1,2)"), ("\\tfrac{a}{b}", "\\frac{a}{b}"), ("{.5}", "{0.5}"), ("a/b/c", "a/b/c"), ("\\$@", "@"), ("03/4", "03/4"),
    ],
    L.canonical,
)
cases("f35_equivalent", [("\\frac12", "0.5", "1"), ("@", "x=@", "1"), ("\\sqrt{2}", "\\sqrt2", "1"), ("1/2", "2/4", "0"), ("\\frac", "\\frac", "1"), ("7 \\text{ cm}", "7", "1")], lambda a, b: L.equivalent(a, b).cast("int"), "INT")
cases(
    "f36_final_answer",
    [
        ("x = 12 dollars", "12"), ("1,234", "1234"), ("\\frac12", "\\frac{1}{2}"), ("\\sqrt7", "\\sqrt{7}"), ("\\text{blue}", "blue"), ("the answer $x@$ holds", "x@"), ("an apple", "apple"), ("90^\\circ", "90"), ("\\boxed{@}", "@"), ("\\overline{AB}", "AB"),
        ("5\\text{ cm}", "5"), ("1,2", "12"), ("(1,2)", "(1,2)"),
    ],
    L.final_answer,
)
cases(
    "f37_graded_equal",
    [
        ("12 cm", "12", "1"), ("\\text{blue}", "Blue", "1"), ("1,000", "1000", "1"), ("(1, 2)", "(1,2)", "1"), ("(1,2)", "[1,2]", "0"), ("2/4", "1/2", "0"), ("$5", "5", "1"), ("3 million", "3*10^6", "1"), ("@", "@.0", "1"), ("1.50", "1.5", "1"),
        ("7", "8", "0"), ("90 degrees", "90", "1"), ("(1,2,3)", "(1,2)", "0"),
    ],
    lambda a, b: L.graded_equal(a, b).cast("int"), "INT",
)
cases(
    "f38_math_equal",
    [
        ("0.5", "50", "1"), ("1/2", "0.5", "1"), ("33.333", "33.3333333", "1"), ("1.01", "1", "0"), ("(1, 2.0)", "(1,2)", "1"), ("[1,2]", "[1,3]", "0"), ("{x}", "x", "1"), ("50%", "0.5", "1"), ("\\frac{1}{4}", "25", "1"), ("1,234", "1234", "1"), ("Yes", " yes", "1"),
        ("[1,2,3,4]", "\\begin{pmatrix}1&2\\\\3&4\\end{pmatrix}", "1"), ("$12.5", "12.5", "1"), ("a", "b", "0"),
    ],
    lambda a, b: L.math_equal(a, b).cast("int"), "INT",
)
cases("f39_evaluated_equal", [("(2*3, 5+2)", "(6,7)", "1"), ("\\frac{1}{2}+@", "@.5", "1"), ("[1,2]", "(1,2)", "0"), ("2^3", "8", "1"), ("", "", "0"), ("x", "X ", "1"), ("(infty, 2)", "(infty,1+1)", "1"), ("1/3", "0.333", "1")], lambda a, b: F.pandas_udf(lambda p, q: p.combine(q, L.evaluated_equal).astype("int32"), "int")(a, b), "INT")
cases("f41_match_choice", [("A", "A,B", "1"), ("C", "A,B", "0"), ("B", "B", "1")], lambda x, g: H.match_choice(F.split(g, ","), x).cast("int"), "INT")
cases("f41_match_open", [("The answer is 12.004", "12", "1"), ("so it is the Blue jay", "blue JAY;crow", "1"), ("x = 3", "4", "0"), ("it is @", "@.001", "1"), ("b", "b", "1")], lambda x, g: H.match_open(F.split(g, ";"), H.parse_open(x)).cast("int"), "INT")
cases("f43_typed_choice", [("(b) something", "blue jay"), ("C", "green frog"), ("red foxes", "red fox"), (" blck cat ", "black cat"), ("(Z)", "red fox")], lambda x: H.typed_answer(x, "multi_choice", options()))
cases("f43_typed_integer", [("12.9", "12"), ("-3.2", "-3"), ("x", "none"), ("@", "@")], lambda x: F.coalesce(H.typed_answer(x, "integer"), F.lit("none")))
cases("f43_typed_float", [("2.346", "2.35"), ("x", "none"), ("1e2", "100.0")], lambda x: F.coalesce(H.typed_answer(x, "float", precision=2), F.lit("none")))
cases("f46_trim_zeros", [("1.500", "1.5"), ("@.0", "@"), ("x", "x"), ("0.25", "0.25"), ("10", "10")], H.trim_zeros)
cases("f47_in_area", [("test/algebra/@.json", "algebra", "1"), ("abstract_algebra_test.csv_@", "algebra", "1"), ("abstract_algebra_test.csv_@", "precalculus", "0"), ("x", "all", "1"), ("algebra", "algebra", "0")], lambda x, a: H.in_area(x, a).cast("int"), "INT")
cases("f51_graded_format", [("<think>§</think> b <answer>c</answer>", "1.0"), ("so \\boxed{@}", "1.0"), ("we add 12 + 30 and then the total of all parts must be = 42", "0.8"), ("short 3", "0.0"), (" <think>a</think><answer>c</answer>", "0.0")], H.graded_format, "DOUBLE")
cases(
    "f52_trace_format",
    [
        ("<think>§</think><answer>@</answer>", "1.0"), ("<think>§</think><tool_call>b</tool_call><think>c</think><answer>d</answer>", "1.0"), ("<think>§</think><tool_call>b</tool_call><answer>d</answer>", "0.0"), ("<think>§<answer>d</answer>", "0.0"),
        ("<think>§</think><answer>x</answer><answer>y</answer>", "0.0"), (" <think>§</think>\n<answer>b</answer>\n", "1.0"), ("<think>§</think><answer>" + "z" * 1000 + "</answer>", "0.0"), ("<think>§</think> text <answer>b</answer>", "0.0"),
    ],
    H.trace_format, "DOUBLE",
)
cases(
    "f54_grounding_iou",
    [("<think>§</think><answer>[0, 10]</answer>", "[5, 10]", "1.5"), ("<think>§</think><answer>[0, 5]</answer>", "[5, 10]", "1.0"), ("<answer>[0, 10]</answer>", "[0, 10]", "1.0"), ("<think>§</think><answer>ten</answer>", "[5, 10]", "1.0"), ("none", "[1, 2]", "0.0"), ("<think>§</think><answer>[1, 2, 3]</answer>", "[1, 2]", "1.0")],
    lambda x, t: H.grounding_reward(x, t)["score"], "DOUBLE",
)
cases("f54_grounding_recall", [("<think>§</think><answer>[0, 10]</answer>", "[5, 15]", "0.5"), ("<think>§</think><answer>[0, 20]</answer>", "[5, 15]", "1.0"), ("x", "[5, 15]", "0.0")], lambda x, t: H.grounding_reward(x, t, True)["acc"], "DOUBLE")
cases("f55_judge_verdict", [("1", "1.0"), (" 0.5 ", "0.5"), ("0", "0.0"), ("Judgement: 0.5", "0.5"), ("x Judgement: 1.", "1.0"), ("maybe", "0.0"), ("Judgement: 0.51", "1.0"), ("11", "0.0")], H.judge_verdict, "DOUBLE")
cases("f56_boxed_format_score", [("<think>§</think> \\boxed{1/2}", "0.5", "1.0"), ("\\boxed{7}", "7", "0.9"), ("<think>§</think>\\boxed{8}", "7", "0.1"), ("x", "7", "0.0")], lambda x, t: F.round(0.9 * F.coalesce(L.boxed_score(x, t), F.lit(0.0)) + 0.1 * H.boxed_format(x), 6), "DOUBLE")
cases("f58_boxed_equal", [("so \\boxed{@}", "@", "1"), ("\\boxed{1}\\boxed{2}", "1", "0"), ("none", "1", "0"), ("\\boxed{{a}}", "{a}", "1")], L.boxed_equal, "INT", noise="before")
cases("f59_remote_verdict", [("\\boxed{True}", "1.0"), ("\\boxed{False}", "0.0"), ("True", "0.0"), ("\\boxed{False} no: \\boxed{True}", "1.0")], lambda x: L.boxed_equal(x, F.lit("True")).cast("double"), "DOUBLE", noise="before")
cases("f60_pass_fraction_first", [("1,1,0,1", "0.75"), ("1", "1.0"), ("1,1,1,1,1,1,1,1,1,1,0,0", "1.0"), ("0,0", "0.0")], lambda x: H.pass_fraction(F.transform(F.split(x, ","), lambda v: v == "1")), "DOUBLE")
cases("f61_minerva_score", [("Answer: @", "@", "1.0:@"), ("Answer: 1\nanswer : 2,000", "2000", "1.0:2000"), ("nothing", "3", "-1.0:[INVALID]"), ("Answer: x = 12 cm", "12", "1.0:12"), ("Answer: 5", "6", "-1.0:5")], lambda x, t: F.concat(L.minerva_score(x, t)["score"].cast("string"), F.lit(":"), L.minerva_score(x, t)["pred"]), noise="before")
cases(
    "f62_parse_periods",
    [("A. or B. @", "B"), ("", "API Error"), ("it is C: the frog", "C"), ("(D) @", "D"), ("so B then A !", "A"), ("the animal must be the green frog today", "C"), ("hm", "No Answer Found."), ("A. and B: @", "A")],
    lambda x: H.parse_periods(x, letters(), options()),
)
cases("f63_letter_list", [("A, B and C", "2", "A|B"), ("only D @", "3", "D||"), ("none", "2", "|"), ("AB C", "1", "C")], lambda x, n: F.array_join(H.letter_list(x, n.cast("int")), "|"))
cases("f64_same_output", [("a;b", "a\nb\n", "1"), (" a ; b", "a\nb", "1"), ("a;c", "a\nb", "0"), ("@;", "@", "1")], lambda x, t: H.same_output(F.split(x, ";"), t).cast("int"), "INT")
cases("f65_graded_box", [("so \\boxed{\\frac12}", "0.5;9", "1.0:1.0"), ("\\boxed{3}", "\\boxed{4};\\boxed{3}", "1.0:1.0"), ("\\boxed{3}", "4", "0.0:1.0"), ("3", "3", "0.0:0.0")], lambda x, g: F.concat_ws(":", L.graded_box(x, F.split(g, ";"))["score"].cast("string"), L.graded_box(x, F.split(g, ";"))["format_score"].cast("string")), noise="before")
cases("f5_last_boxed", [("\\boxed{1} \\boxed{@}", "@"), ("\\boxed{a{b}}", "none"), ("none", "none"), ("\\boxed{}", "")], lambda x: F.coalesce(X.last_boxed(x), F.lit("none")), noise="before")
cases("f6_boxed_balanced", [("\\boxed{1} \\boxed{@}", "@"), ("\\boxed{a{b}{c}}d}", "a{b}{c}"), ("\\boxed{a{b}", "none"), ("x", "none"), ("\\boxed{\\frac{1}{@}} }", "\\frac{1}{@}")], lambda x: F.coalesce(X.last_boxed_balanced(x), F.lit("none")), noise="before")
cases("f10_letter", [("Answer: B", "B"), ("answer :$C$ and Answer: D", "C"), ("Answer:E", ""), ("none", "")], X.letter_answer, noise="before")
cases("f31_exact_match", [("The Fox!", "1"), ("fox a", "1"), ("foxes", "0"), ("WOLF.", "1"), ("an  owl", "0")], lambda x: X.exact_match(x, F.array(F.lit("fox"), F.lit("the wolf"))), "INT")
cases("f31_sub_match", [("I saw the Fox!", "1"), ("foxes run", "1"), ("an owl", "0"), ("WOLF @", "1"), ("wo lf", "0")], lambda x: X.sub_match(x, F.array(F.lit("fox"), F.lit("the wolf"))), "INT", noise="before")
cases("f40_number_or_lower", [("3.14159", "3.14"), ("ABC", "abc"), ("7", "7.0"), ("1e3", "1000.0")], lambda x: F.coalesce(F.round(x.try_cast("double"), 2).cast("string"), F.lower(x)))


cases("f66_repetitiveness_known", [("aaaa", "0.6"), ("abcd", "0.0"), ("abab", "0.3"), ("", "0.0"), ("x", "0.0"), ("aa", "0.333333")], lambda x: F.round(F.pandas_udf(lambda s: s.map(X.repetitiveness), "double")(x), 6), "DOUBLE")


@query("f76_rounds", "SELECT doc_id, CASE WHEN length(text) * 1.0 < 900 THEN 1 WHEN ('0x' || left(md5(lang || doc_id), 8))::UBIGINT % 16777216 / 16777216.0 < (least(length(text), 1200) - 900) / 300.0 THEN 2 ELSE 1 END::INT AS value FROM documents")
def f76(t):
    return t.documents.select("doc_id", H.rounds_for(F.concat(c("lang"), c("doc_id").cast("string")), F.length("text").cast("double")).cast("int").alias("value"))


@query("p19_coalesce_chain", "SELECT event_id, coalesce(json_extract_string(props, '$.answer'), json_extract_string(props, '$.solution'), json_extract_string(props, '$.k'), 'none') AS value FROM events")
def p19(t):
    get = lambda k: F.get_json_object("props", f"$.{k}")
    return t.events.select("event_id", F.coalesce(get("answer"), get("solution"), get("k"), F.lit("none")).alias("value"))


@query("t9_last_candidate", "SELECT doc_id, (SELECT arg_max(w, -strpos(reverse(text), reverse(w)) ) FROM (VALUES ('the '), ('a '), ('of '), ('and ')) v(w) WHERE strpos(text, w) > 0) AS value FROM documents")
def t9(t):
    at = F.transform(F.array(*map(F.lit, ("the ", "a ", "of ", "and "))), lambda w: F.struct((H.rfind(c("text"), w) + F.length(w)).alias("at"), w.alias("w")))
    found = F.filter(at, lambda s: F.contains(c("text"), s["w"]))
    return t.documents.select("doc_id", F.array_max(found)["w"].alias("value"))


@query("f53_composite", """WITH d AS (SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL), x AS (SELECT doc_id, (n % 3 = 0)::INT::DOUBLE AS acc, (n % 5 <> 0)::INT::DOUBLE AS form, n % 2 = 0 AS used, (n % 40)::DOUBLE AS s, n % 40 + 15.0 AS e FROM d),
y AS (SELECT *, greatest(least(e, 40) - greatest(s, 20), 0) AS meet FROM x)
SELECT doc_id, round(0.8 * acc + 0.2 * form, 6) AS weighted, acc + form AS equal, acc + form + (used AND acc >= 0.5)::INT AS tool, round(acc + form + used::INT * meet / 20, 6) AS recall, round(acc + form + used::INT * meet / (greatest(e, 40) - least(s, 20)), 6) AS iou FROM y""")
def f53(t):
    """All variants over replies that think a whole text, crop a video (some with a tool's reply), and answer; some lack the format."""
    n = F.length("text")
    call = F.format_string("<tool_call>{'name': 'crop_video', 'arguments': {'start_time': %d, 'end_time': %d}}</tool_call>", n % 40, n % 40 + 15)
    reply = F.concat(F.when(n % 5 == 0, "so ").otherwise(""), F.lit("<think>"), "text", F.lit("</think>"), call, F.when(n % 2 == 0, "<tool_response>ok</tool_response>").otherwise(""), F.lit("<answer>x</answer>"))
    d = X.staged(t.documents.where("text is not null"), {"reply": reply, "acc": (n % 3 == 0).cast("double")})
    kinds = ("weighted", "equal", "tool", "recall", "iou")
    return d.select("doc_id", *[F.round(H.composite_reward(c("reply"), c("acc"), F.lit(20.0), F.lit(40.0), k)["score"], 6).alias(k) for k in kinds])


@query("f77_boxes", """WITH d AS (SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL), b AS (SELECT doc_id, greatest(n % 97 - 10, 0)::DOUBLE AS l, greatest(n // 7 % 53 - 5, 0)::DOUBLE AS t, least(n % 97 - 10 + n % 211, 160)::DOUBLE AS r, least(n // 7 % 53 - 5 + n // 3 % 173, 120)::DOUBLE AS b FROM d),
v AS (SELECT *, r - l > 0 AND b - t > 0 AND least(r - l, b - t) > 10 AND greatest(r - l, b - t) <= 4 * least(r - l, b - t) AS ok, 28 / least(r - l, b - t) AS k FROM b),
g AS (SELECT doc_id, l, t, r, b, ok, least(r - l, b - t) >= 28 AS fits, floor((l + r) / 2 - ceil((r - l) * k * 0.5)) AS gl, floor((t + b) / 2 - ceil((b - t) * k * 0.5)) AS gt, ceil((l + r) / 2 + ceil((r - l) * k * 0.5)) AS gr, ceil((t + b) / 2 + ceil((b - t) * k * 0.5)) AS gb FROM v),
f AS (SELECT *, ok AND (fits OR (gr > gl AND gb > gt AND least(gr - gl, gb - gt) > 10 AND greatest(gr - gl, gb - gt) <= 4 * least(gr - gl, gb - gt))) AS valid FROM g)
SELECT doc_id, CASE WHEN valid THEN CASE WHEN fits THEN l ELSE gl END END::DOUBLE AS l, CASE WHEN valid THEN CASE WHEN fits THEN t ELSE gt END END::DOUBLE AS t, CASE WHEN valid THEN CASE WHEN fits THEN r ELSE gr END END::DOUBLE AS r, CASE WHEN valid THEN CASE WHEN fits THEN b ELSE gb END END::DOUBLE AS b FROM f""")
def f77(t):
    """Boxes by the texts' lengths, partly outside a picture of 160 x 120, small or narrow ones among them."""
    n = F.length("text")
    left, top = n % 97 - 10, F.floor(n / 7) % 53 - 5
    box = H.fitted_box(left, top, left + n % 211, top + F.floor(n / 3) % 173, F.lit(160), F.lit(120), small=10, ratio=4)
    return X.staged(t.documents.where("text is not null"), {"box": box}).select("doc_id", *[c("box")[k].alias(k[0]) for k in ("left", "top", "right", "bottom")])


@query("f75_keep_area", """WITH d AS (SELECT doc_id, length(text) + 1 AS w, length(text) % 700 + 1 AS h FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN w * h <= 200000 THEN w ELSE greatest(1, floor(w * sqrt(200000 / (w * h)))) END::BIGINT AS width, CASE WHEN w * h <= 200000 THEN h ELSE greatest(1, floor(h * sqrt(200000 / (w * h)))) END::BIGINT AS height FROM d""")
def f75(t):
    w, h = F.length("text") + 1, F.length("text") % 700 + 1
    return X.staged(t.documents.where("text is not null"), {"size": H.kept_area(w, h, 200_000)}).select("doc_id", "size.width", "size.height")
