from pyspark.sql import functions as F

from quern.operators import staged as G


def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, request string, status int, answer string")


def asked(log, name, answer, status="200"):
    def ask(requests):
        log.append((name, sorted((r.key, r.attempt) for r in requests.collect())))
        return requests.selectExpr("key", f"{answer} AS answer", f"{status} AS status")

    return ask


def test_only_what_failed_is_asked_again(spark):
    log = []
    good = '\'{"queries":["1","2","3","4"]}\''
    first = G.Stage("first", asked(log, "first", f"if(key = 'b', null, {good})", "if(key in ('c', 'd') and attempt < 3, 429, if(key = 'e', 400, 200))"), 2)
    second = G.Stage("second", asked(log, "second", f"if(key = 'd', 'x', {good})"), 1)
    got = G.run_stages(frame(spark, [(k, "q", 1, "z") for k in "abcde"]), [first, second], G.plan_problem)
    assert sorted((r.key, r.model, r.attempts) for r in got.answers.collect()) == [("a", "first", 1), ("b", "second", 2), ("c", "second", 3), ("e", "second", 2)]
    assert [(r.key, r.attempts, r.problem) for r in got.dead.collect()] == [("d", 3, "no queries")]
    assert log == [("first", [(k, 1) for k in "abcde"]), ("first", [("c", 2), ("d", 2)]), ("second", [("b", 2), ("c", 3), ("d", 3), ("e", 2)])]
    assert got.attempts.count() == 5 + 2 + 4


def test_empty_and_repeated_answers(spark):
    def twice(requests):
        return requests.selectExpr("key", "inline(array(struct('{}' AS answer, 200 AS status), struct('{\"queries\":[\"1\",\"2\",\"3\",\"4\"]}' AS answer, 200 AS status)))")

    got = G.run_stages(frame(spark, [("a", None, None, None)]), [G.Stage("m", twice)], G.plan_problem)
    assert got.answers.count() + got.dead.count() == 1
    none = G.run_stages(frame(spark, []), [G.Stage("m", twice)], G.plan_problem)
    assert none.answers.collect() == none.dead.collect() == none.attempts.collect() == []


def test_gates(spark):
    plans = ['{"queries":["a","b","c","d"]}', '{"queries":["a","b","c"]}', '{"queries":["a","b","c","A","d"]}', '{"queries":[" ",null,"a","b","c","d"]}', '{"queries":"abcd"}', "[]", None, '{"queries":["a","b","c","d"]} x']
    df = spark.createDataFrame([(p,) for p in plans], "p string")
    assert [r.x for r in df.select(G.plan_problem(F.col("p")).alias("x")).collect()] == [None, "3 queries", "repeated queries", None, "no queries", "no queries", "no queries", "no queries"]
    intakes = ['{"status":"ASK","question":"?"}', '{"status":"ask"}', '{"status":5}', None]
    df = spark.createDataFrame([(p,) for p in intakes], "p string")
    assert [r.x for r in df.select(G.intake_problem(F.col("p")).alias("x")).collect()] == [None, "no question", "status 5", "no status"]
