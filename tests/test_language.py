"""Literal expressions: value and order of their items as strings."""

import pytest
from pyspark.sql import functions as F

from canopyql.engine import Engine
from canopyql.functions.library import FUNCTIONS
from canopyql.plans.compiler import Env
from canopyql.plans.model import PathError, arr
from canopyql.plans.parser import PathSyntaxError, parse

CASES = """
1 + 2 * 3 => 7 | (1 + 2) * 3 => 9 | 7 idiv 2 => 3 | -7 idiv 2 => -3 | -7 mod 3 => -1 | 1 div 4 => 0.25 | 2.5 + 1 => 3.5 | 1e3 + 1 => 1001 | -(3) => -3 | 5 - -2 => 7
round(2.5) => 2 | round(3.5) => 4 | round(-1.5) => -2 | floor(2.7) => 2 | ceiling(2.1) => 3 | abs(-4) => 4 | sum(()) => 0 | sum((1, 2, 3.5)) => 6.5 | avg((1, 2)) => 1.5 | min((3, 1, 2)) => 1 | max((3, 1, 2)) => 3 | number('x') => NaN
true() => true | not(1) => false | boolean('') => false | boolean((0)) => false | 1 = (1, 2) => true | (1, 2) != 1 => true | 1 eq 1 => true | (1, 2) eq 1 => false | '10' = '10.0' => true | 'b' > 'a' => true | 1 < 2 and 2 < 1 => false | 1 < 2 or 2 < 1 => true
count((1, (2, 3), ())) => 3 | empty(()) => true | exists(()) => false | head((4, 5)) => 4 | tail((4, 5, 6)) => 5 6 | reverse((1, 2, 3)) => 3 2 1 | distinct-values((1, 2, 1)) => 1 2 | index-of((1, 2, 1), 1) => 1 3 | subsequence((1, 2, 3, 4), 2, 2) => 2 3 | insert-before((1, 2), 2, 9) => 1 9 2 | remove((1, 2, 3), 2) => 1 3 | deep-equal((1, 2), (1, 2)) => true | deep-equal((), ()) => true | unordered((2, 1)) => 2 1
1 to 4 => 1 2 3 4 | 3 to 1 =>  | (1 to 5)[. mod 2 = 1] => 1 3 5 | (1 to 5)[last()] => 5 | (1 to 5)[2] => 2 | (1 to 5)[1 + 1] => 2 | (4, 5)[position() = 2] => 5 | (1, 2) ! (. * 10) => 10 20 | (1 to 3) ! . ! (. + 1) => 2 3 4
if (1 = 1) then 'x' else 'y' => x | for $a in 1 to 2, $b in 1 to 2 return $a * $b => 1 2 2 4 | let $x := 2, $y := $x + 1 return $x * $y => 6 | some $x in (1, 2) satisfies $x = 2 => true | every $x in (1, 2) satisfies $x = 2 => false
(1, 2) union (2, 3) => 1 2 3 | (1, 2, 2) intersect (2) => 2 2 | (1, 2, 3) except (2) => 1 3
'a' => upper-case() => concat('b') => Ab | 'a' || 'b' || 1 => ab1 | concat('a', (), 1) => a1 | string-length('abc') => 3 | normalize-space('  a   b ') => a b | contains('abc', 'b') => true | starts-with('abc', 'ab') => true | ends-with('abc', 'bc') => true | lower-case('AB') => ab
substring('hello', 2, 3) => ell | substring('hello', 0) => hello | substring('hello', 9, 2) =>  | substring-before('a-b', '-') => a | substring-after('a-b', '-') => b | substring-after('a', '') => a | translate('abc', 'ab', 'x') => xc | compare('a', 'b') => -1 | string-join(('a', 'b'), '-') => a-b
codepoints-to-string((72, 105)) => Hi | string-to-codepoints('Hi') => 72 105 | matches('ABC', 'b', 'i') => true | replace('abc', '(b)', '[$1]') => a[b]c | tokenize('a b  c') => a b c | tokenize('a,b', ',') => a b | encode-for-uri('a b') => a%20b | mp:base64-encode('hi') => aGk= | mp:base64-decode('aGk=') => hi
'3' cast as xs:integer => 3 | 'x' castable as xs:integer => false | '3' castable as xs:integer => true | 5 instance of xs:integer => true | 'a' instance of xs:integer => false | (1, 2) instance of xs:integer+ => true | 5 treat as xs:integer => 5
[1, 2]?* => 1 2 | [1, 2]?2 => 2 | array:size([1, 2, 3]) => 3 | array:get([4, 5], 2) => 5 | array:put([4, 5], 1, 9)?* => 9 5 | array:append([4], 5)?* => 4 5 | array:subarray([1, 2, 3], 2)?* => 2 3 | array:remove([1, 2], 1)?* => 2 | array:insert-before([1, 2], 1, 9)?* => 9 1 2 | array:head([7, 8]) => 7 | array:tail([7, 8])?* => 8 | array:reverse([1, 2])?* => 2 1 | array:flatten([1, 2]) => 1 2 | array { 1 to 3 }?3 => 3
map{'a': 1}?a => 1 | map:size(map{'a': 1, 'b': 2}) => 2 | map:contains(map{'a': 1}, 'a') => true | map:get(map:put(map{'a': 1}, 'b', 2), 'b') => 2 | map:keys(map:remove(map{'a': 1, 'b': 2}, 'a')) => b | map:get(map:merge((map{'a': 1}, map{'a': 2})), 'a') => 2
let $f := function($x) { $x + 1 } return $f(2) => 3 | let $f := upper-case#1 return $f('a') => A | (: a (: nested :) comment :) 1 => 1 | 'it''s' => it's | string(1.50) => 1.5
xs:date('2020-01-02') lt xs:date('2020-01-03') => true | year-from-date(xs:date('2020-01-02Z')) => 2020 | month-from-dateTime(xs:dateTime('2020-03-04T05:06:07')) => 3 | hours-from-time(xs:time('05:06:07')) => 5 | seconds-from-dateTime(xs:dateTime('2020-03-04T05:06:07.25Z')) => 7.25
days-from-duration(xs:dayTimeDuration('P3DT4H')) => 3 | hours-from-duration(xs:dayTimeDuration('P3DT4H')) => 4 | minutes-from-duration(xs:dayTimeDuration('PT90M')) => 30 | years-from-duration(xs:duration('P1Y2M')) => 1 | months-from-duration(xs:duration('P1Y2M')) => 2 | string(xs:duration('P1Y2M3DT4H5M6.5S')) => P1Y2M3DT4H5M6.5S
string(adjust-dateTime-to-timezone(xs:dateTime('2020-01-02T03:04:05+02:00'), xs:dayTimeDuration('PT0S'))) => 2020-01-02T01:04:05Z | string(timezone-from-time(xs:time('01:02:03+05:30'))) => PT5H30M | string(dateTime(xs:date('2020-01-02'), xs:time('03:04:05'))) => 2020-01-02T03:04:05Z
local-name-from-QName(QName('u', 'p:l')) => l | prefix-from-QName(QName('u', 'p:l')) => p | namespace-uri-from-QName(QName('u', 'l')) => u | resolve-uri('b', 'http://x/a') => http://x/b | doc-available('u') => false | position() => 1 | last() => 1
"""
PAIRS = [c.rpartition(" => ")[::2] for line in CASES.strip().splitlines() for c in line.split(" | ")]


def test_literals(spark):
    """All in one job: one row, a column each."""
    eng = Engine(spark)
    c = eng.compiler()
    cols = []
    for i, (e, _) in enumerate(PAIRS):
        v = c.strings(c.compile(e, Env()))
        cols.append(F.concat_ws(" ", arr(v)).alias(f"c{i}"))
    wrong = []
    for s in range(0, len(cols), 60):
        row = spark.range(1).select(*cols[s : s + 60]).first()
        wrong += [(PAIRS[s + i], x) for i, x in enumerate(row) if x != PAIRS[s + i][1].strip()]
    assert not wrong


def test_library_is_whole():
    assert len(FUNCTIONS) == 123


@pytest.mark.parametrize("bad", ["1 + * 2", "", "  ", "invalid @ expression", "(1", "'a", "for $x return 1", "//"])
def test_syntax_errors(bad):
    with pytest.raises(PathSyntaxError):
        parse(bad)


@pytest.mark.parametrize("bad", ["nope(1)", "count()", "$x", "a/b", "1 cast as xs:nope"])
def test_compile_errors(spark, bad):
    with pytest.raises(PathError):
        Engine(spark).value(bad)


@pytest.mark.parametrize("bad", ["zero-or-one((1, 2))", "exactly-one(())", "one-or-more(())", "'x' cast as xs:integer", "1 idiv 0"])
def test_run_time_errors(spark, bad):
    with pytest.raises(Exception):  # noqa: B017  Spark wraps it
        Engine(spark).literal(bad)


def test_own_function(spark):
    eng = Engine(spark)
    eng.register_function("twice", 1, lambda x: F.concat(x, x))
    assert eng.literal("twice('ab')") == ["abab"]


def test_overloads_by_arity(spark):
    eng = Engine(spark)
    eng.register_function("contains", 1, lambda x: F.concat(x, F.lit("?")))
    eng.register_function("both", 2, lambda x, y: F.concat(y, x))
    assert eng.literal("contains('a')") == ["a?"] and eng.literal("contains('ab', 'b')") == ["true"] and eng.literal("both('a', 'b')") == ["ba"]
    with pytest.raises(PathError):
        eng.value("both('a')")


def test_functions_of_sequences(spark):
    """An aggregate and a generator of one's own, over nodes too."""
    from canopyql.sources import tables

    eng = Engine(spark)
    eng.register_sequence_function("product", 1, lambda x: F.aggregate(x, F.lit(1.0), lambda a, b: a * b), takes="double", gives="double", many=False)
    eng.register_sequence_function("twice", 1, lambda x: F.flatten(F.transform(x, lambda y: F.array(y, y))))
    eng.register_sequence_function("longest", 2, lambda x, y: F.when(F.size(x) >= F.size(y), x).otherwise(y))
    assert eng.literal("product((2, 3, 4.5))") == ["27"] and eng.literal("product(())") == ["1"] and eng.literal("twice(('a', 'b'))[3]") == ["b"]
    assert eng.literal("longest((1, 2), ())") == ["1", "2"]
    docs = tables.conversations(eng, "/root/testdata/sf0.001")
    counts = {r.conv_id: r.value for r in docs.eval("count(twice(turn/@role))").collect()}
    assert counts == {r.conv_id: 2 * r.value for r in docs.eval("count(turn)").collect()}


@pytest.mark.parametrize("values", [[0.1] * 10, [1e16, 1.0, -1e16, 1.0], [3.3, 1e300, -1e300, 2.2], [float("inf"), 1.0], [float("inf"), float("-inf")], [float("nan"), 1.0]])
def test_sum_of_any_order(spark, values):
    """Correctly rounded but for an ulp, and the same for each order."""
    import itertools
    import math

    orders = [list(x) for x in itertools.islice(itertools.permutations(values), 24)]
    from canopyql.functions.library import _total
    from canopyql.plans.model import V

    got = [r[0] for r in spark.createDataFrame([(x,) for x in orders], "v array<double>").select(_total(V("double", F.col("v"), True))).collect()]
    assert len(set(map(str, got))) == 1
    if all(map(math.isfinite, values)):
        assert got[0] == pytest.approx(math.fsum(values), rel=1e-15, abs=1e-15)
    else:
        assert str(got[0]) == str(float(np_sum(values)))


def np_sum(values):
    total = 0.0
    for x in sorted(values, key=lambda v: (v != v, v)):
        total += x
    return total
