import pytest

from tessera.functions.throttle import Bucket
from tessera.service import Service, ServiceError, fnv, key_bytes
from tessera.streaming import feed as streaming
from tessera.operators import log

from pyspark.sql import functions as F


class Clock:
    now = 1_000_000.0

    def __call__(self):
        return self.now


@pytest.fixture
def store(spark, tmp_path):
    clock = Clock()
    s = Service(spark, str(tmp_path), clock)
    s.call("CreateTable", {
        "TableName": "T",
        "KeySchema": [{"AttributeName": "pk", "KeyType": "HASH"}, {"AttributeName": "sk", "KeyType": "RANGE"}],
        "AttributeDefinitions": [{"AttributeName": "pk", "AttributeType": "S"}, {"AttributeName": "sk", "AttributeType": "N"}, {"AttributeName": "g", "AttributeType": "S"}],
        "GlobalSecondaryIndexes": [{"IndexName": "G", "KeySchema": [{"AttributeName": "g", "KeyType": "HASH"}, {"AttributeName": "sk", "KeyType": "RANGE"}], "Projection": {"ProjectionType": "INCLUDE", "NonKeyAttributes": ["v"]}}],
        "StreamSpecification": {"StreamEnabled": True},
    })
    return s, clock


def item(pk, sk, **rest):
    return {"pk": {"S": pk}, "sk": {"N": str(sk)}} | rest


def key(pk, sk):
    return {"pk": {"S": pk}, "sk": {"N": str(sk)}}


def fill(s, rows):
    for a in range(0, len(rows), 25):
        s.call("BatchWriteItem", {"RequestItems": {"T": [{"PutRequest": {"Item": x}} for x in rows[a : a + 25]]}})


def test_items(store):
    s, clock = store
    assert s.call("PutItem", {"TableName": "T", "Item": item("p", 1, v={"N": "1.50"})}) == {}
    assert s.call("GetItem", {"TableName": "T", "Key": key("p", 1)})["Item"]["v"] == {"N": "1.5"}
    assert s.call("GetItem", {"TableName": "T", "Key": key("p", 2)}) == {}
    with pytest.raises(ServiceError, match="ConditionalCheckFailed"):
        s.call("PutItem", {"TableName": "T", "Item": item("p", 1), "ConditionExpression": "attribute_not_exists(pk)"})
    up = {"TableName": "T", "Key": key("p", 1), "UpdateExpression": "SET v = v + :a, w = :b", "ExpressionAttributeValues": {":a": {"N": "2"}, ":b": {"S": "x"}}}
    assert s.call("UpdateItem", up | {"ReturnValues": "UPDATED_NEW"}) == {"Attributes": {"v": {"N": "3.5"}, "w": {"S": "x"}}}
    assert s.call("UpdateItem", {"TableName": "T", "Key": key("q", 9), "UpdateExpression": "ADD n :a", "ExpressionAttributeValues": {":a": {"N": "1"}}, "ReturnValues": "ALL_NEW"})["Attributes"]["n"] == {"N": "1"}
    assert s.call("DeleteItem", {"TableName": "T", "Key": key("p", 1), "ReturnValues": "ALL_OLD"})["Attributes"]["w"] == {"S": "x"}
    for bad in ({"pk": {"S": ""}, "sk": {"N": "1"}}, {"pk": {"S": "a"}}, item("a", 1, g={"N": "1"}), item("a", 1, x={"SS": []})):
        with pytest.raises(ServiceError, match="ValidationException"):
            s.call("PutItem", {"TableName": "T", "Item": bad})
    s.call("UpdateTimeToLive", {"TableName": "T", "TimeToLiveSpecification": {"Enabled": True, "AttributeName": "ttl"}})
    s.call("PutItem", {"TableName": "T", "Item": item("p", 5, ttl={"N": str(int(clock.now) + 10)})})
    assert s.call("GetItem", {"TableName": "T", "Key": key("p", 5)})["Item"]
    clock.now += 11
    assert s.call("GetItem", {"TableName": "T", "Key": key("p", 5)}) == {}
    assert s.call("DescribeTable", {"TableName": "T"})["Table"]["ItemCount"] == 2
    assert s.call("ListTables", {}) == {"TableNames": ["T"]}


def test_query_scan_pages_indexes(store):
    s, _ = store
    fill(s, [item("p" if i < 30 else f"q{i}", i, v={"N": str(i)}, **({"g": {"S": "x"}} if i % 3 == 0 else {})) for i in (*range(10, 40), *range(10))])
    q = {"TableName": "T", "KeyConditionExpression": "pk = :p AND sk BETWEEN :a AND :b", "ExpressionAttributeValues": {":p": {"S": "p"}, ":a": {"N": "2"}, ":b": {"N": "11"}}}
    sks = lambda out: [int(x["sk"]["N"]) for x in out["Items"]]
    assert sks(s.call("Query", q)) == list(range(2, 12))
    assert sks(s.call("Query", q | {"ScanIndexForward": False, "Limit": 3})) == [11, 10, 9]
    f = q | {"FilterExpression": "NOT v < :f", "ExpressionAttributeValues": q["ExpressionAttributeValues"] | {":f": {"N": "9"}}}
    got = s.call("Query", f)
    assert (sks(got), got["Count"], got["ScannedCount"]) == ([9, 10, 11], 3, 10)
    assert s.call("Query", f | {"Select": "COUNT"}) == {"Count": 3, "ScannedCount": 10}
    seen, start = [], None
    while True:
        page = s.call("Query", {"TableName": "T", "KeyConditionExpression": "pk = :p", "ExpressionAttributeValues": {":p": {"S": "p"}}, "Limit": 12} | ({"ExclusiveStartKey": start} if start else {}))
        seen += sks(page)
        start = page.get("LastEvaluatedKey")
        if not start:
            break
    assert seen == list(range(30))
    seen, start = [], None
    while True:
        page = s.call("Scan", {"TableName": "T", "Limit": 15} | ({"ExclusiveStartKey": start} if start else {}))
        seen += sks(page)
        start = page.get("LastEvaluatedKey")
        if not start:
            break
    assert sorted(seen) == list(range(40)) and seen == [*range(30), *range(30, 40)]
    parts = [set(sks(s.call("Scan", {"TableName": "T", "Segment": i, "TotalSegments": 3}))) for i in range(3)]
    assert set().union(*parts) == set(range(40)) and sum(map(len, parts)) == 40
    table = s.definition("T")
    assert parts[1] == {i for i in range(40) if fnv(key_bytes(table, item("p" if i < 30 else f"q{i}", i))) % 3 == 1}
    index = {"TableName": "T", "IndexName": "G", "KeyConditionExpression": "g = :g AND sk > :a", "ExpressionAttributeValues": {":g": {"S": "x"}, ":a": {"N": "20"}}}
    assert sks(s.call("Query", index)) == [21, 24, 27, 30, 33, 36, 39]
    assert set(s.call("Query", index)["Items"][0]) == {"pk", "sk", "g", "v"}
    assert s.call("Scan", {"TableName": "T", "IndexName": "G"})["Count"] == 14
    legacy = s.call("Query", {"TableName": "T", "KeyConditions": {"pk": {"ComparisonOperator": "EQ", "AttributeValueList": [{"S": "p"}]}, "sk": {"ComparisonOperator": "EQ", "AttributeValueList": [{"N": "7"}]}}})
    assert sks(legacy) == [7]
    got = s.call("BatchGetItem", {"RequestItems": {"T": {"Keys": [key("p", 3), key("none", 1)]}}})
    assert [x["sk"] for x in got["Responses"]["T"]] == [{"N": "3"}]
    assert [bool(x) for x in s.call("TransactGetItems", {"TransactItems": [{"Get": {"TableName": "T", "Key": key("none", 1)}}, {"Get": {"TableName": "T", "Key": key("p", 3)}}]})["Responses"]] == [False, True]
    assert s.compact("T") == 40 and s.call("Scan", {"TableName": "T", "Select": "COUNT"})["Count"] == 40


def test_transactions(store):
    s, clock = store
    put = {"TransactItems": [{"Put": {"TableName": "T", "Item": item("a", 1)}}, {"Update": {"TableName": "T", "Key": key("b", 1), "UpdateExpression": "SET v = :v", "ExpressionAttributeValues": {":v": {"N": "1"}}}}], "ClientRequestToken": "t"}
    s.call("TransactWriteItems", put)
    s.call("TransactWriteItems", put)
    with pytest.raises(ServiceError, match="Idempotent"):
        s.call("TransactWriteItems", put | {"TransactItems": put["TransactItems"][:1]})
    bad = {"TransactItems": [{"Delete": {"TableName": "T", "Key": key("a", 1)}}, {"ConditionCheck": {"TableName": "T", "Key": key("b", 1), "ConditionExpression": "v = :v", "ExpressionAttributeValues": {":v": {"N": "2"}}}}]}
    with pytest.raises(ServiceError) as e:
        s.call("TransactWriteItems", bad)
    assert [x["Code"] for x in e.value.more["CancellationReasons"]] == ["None", "ConditionalCheckFailed"]
    assert s.call("GetItem", {"TableName": "T", "Key": key("a", 1)})["Item"]


def test_streams_and_backups(store):
    s, clock = store
    s.call("PutItem", {"TableName": "T", "Item": item("a", 1, v={"N": "1"})})
    backup = s.call("CreateBackup", {"TableName": "T", "BackupName": "b"})["BackupDetails"]
    assert backup["BackupSizeBytes"] == 1024
    then = clock.now
    clock.now += 5
    s.call("PutItem", {"TableName": "T", "Item": item("a", 1, v={"N": "2"})})
    s.call("DeleteItem", {"TableName": "T", "Key": key("a", 1)})
    s.call("DeleteItem", {"TableName": "T", "Key": key("a", 1)})
    arn = s.call("ListStreams", {})["Streams"][0]["StreamArn"]
    assert s.call("DescribeStream", {"StreamArn": arn})["StreamDescription"]["StreamViewType"] == "NEW_AND_OLD_IMAGES"
    it = s.call("GetShardIterator", {"StreamArn": arn, "ShardIteratorType": "TRIM_HORIZON"})["ShardIterator"]
    got = s.call("GetRecords", {"ShardIterator": it})
    assert [x["eventName"] for x in got["Records"]] == ["INSERT", "MODIFY", "REMOVE"]
    assert got["Records"][1]["dynamodb"]["OldImage"]["v"] == {"N": "1"} and got["Records"][0]["dynamodb"]["Keys"] == key("a", 1)
    assert s.call("GetRecords", {"ShardIterator": got["NextShardIterator"]})["Records"] == []
    s.call("RestoreTableFromBackup", {"TargetTableName": "R", "BackupArn": backup["BackupArn"]})
    s.call("RestoreTableToPointInTime", {"SourceTableName": "T", "TargetTableName": "P", "RestoreDateTime": then + 1})
    for name in ("R", "P"):
        assert s.call("GetItem", {"TableName": name, "Key": key("a", 1)})["Item"]["v"] == {"N": "1"}
    s.call("PutItem", {"TableName": "R", "Item": item("b", 2)})
    assert s.call("Scan", {"TableName": "R"})["Count"] == 2
    assert len(s.call("ListBackups", {})["BackupSummaries"]) == 1
    s.call("DeleteBackup", {"BackupArn": backup["BackupArn"]})
    with pytest.raises(ServiceError):
        s.call("DescribeBackup", {"BackupArn": backup["BackupArn"]})
    assert s.call("UpdateContinuousBackups", {"TableName": "T", "PointInTimeRecoverySpecification": {"PointInTimeRecoveryEnabled": True}})["ContinuousBackupsDescription"]["PointInTimeRecoveryDescription"]["PointInTimeRecoveryStatus"] == "ENABLED"
    s.call("CreateGlobalTable", {"GlobalTableName": "T", "ReplicationGroup": [{"RegionName": "local"}]})
    assert s.call("ListGlobalTables", {})["GlobalTables"][0]["GlobalTableName"] == "T"
    s.call("DeleteTable", {"TableName": "P"})
    with pytest.raises(ServiceError):
        s.call("DescribeTable", {"TableName": "P"})


def test_partiql(store):
    s, _ = store
    run = lambda text, *params: s.call("ExecuteStatement", {"Statement": text, "Parameters": list(params)}).get("Items")
    run("INSERT INTO T VALUE {'pk': 'a', 'sk': 1, 'n': 1.0, 'tags': ['x', TRUE]}")
    run("INSERT INTO T VALUE {'pk': 'a', 'sk': 2, 'n': 'text'}")
    assert [x["sk"] for x in run('SELECT sk FROM "T" WHERE n = ?', {"N": "1"})] == [{"N": "1"}]
    assert [x["sk"] for x in run("SELECT sk FROM T WHERE n <> 1")] == [{"N": "2"}]
    run("UPDATE T SET n = 5, m = 'y' WHERE pk = 'a' AND sk = 1 AND n >= 1")
    assert run("SELECT * FROM T WHERE pk = 'a' AND sk = 1")[0]["n"] == {"N": "5"}
    with pytest.raises(ServiceError, match="ConditionalCheckFailed"):
        run("UPDATE T SET n = 6 WHERE pk = 'a' AND sk = 1 AND n > 5")
    with pytest.raises(ServiceError, match="Validation"):
        run("DELETE FROM T WHERE pk = 'a'")
    run("DELETE FROM T WHERE pk = 'a' AND sk = 2")
    out = s.call("BatchExecuteStatement", {"Statements": [{"Statement": "SELECT sk FROM T"}, {"Statement": "DROP T"}]})["Responses"]
    assert out[0]["Item"]["sk"] == {"N": "1"} and out[1]["Error"]["Code"] == "ValidationException"


def test_buckets():
    b = Bucket(1.0)
    assert b.take(0, 299) and b.take(0, 5) and not b.take(0, 1) and b.take(10, 1)


def test_stream_equals_batch(spark, tmp_path):
    rows = [("a", 1, "P", '{"v":{"N":"1"}}'), ("a", 2, "P", '{"v":{"N":"2"}}'), ("b", 3, "D", None), ("a", 4, "D", None), ("a", 5, "D", None), ("b", 6, "P", '{"v":{"N":"9"}}'), ("a", 7, "P", '{"v":{"N":"3"}}')]
    schema = "key string, seq long, op string, image string"
    requests = spark.createDataFrame(rows, schema)
    for i, part in enumerate((requests.where("seq <= 3"), requests.where("seq > 3"))):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    streaming.run_to(streaming.fold(stream), str(tmp_path / "out"), str(tmp_path / "check"))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("key", "seq", "event_name", "old_image", "new_image").collect()}
    batch = log.changes(requests, ["key"], ["seq"], F.col("op") == "D")
    want = {tuple(r) for r in batch.select("key", "seq", "event_name", "old_image.image", "new_image.image").collect()}
    assert got == want and len(got) == 5
    guarded = streaming.fold(stream, "attribute_not_exists(v)")
    streaming.run_to(guarded, str(tmp_path / "out2"), str(tmp_path / "check2"))
    status = {r.seq: r.status for r in spark.read.parquet(str(tmp_path / "out2")).collect()}
    assert status[2] == "ConditionalCheckFailed" and status[1] == "OK"


def test_of_many_writers_one_publishes(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from tessera.sources.files import Files

    files = Files(spark, str(tmp_path))
    files.publish("state/0.json", "{}")
    for n in range(1, 11):
        with ThreadPoolExecutor(8) as pool:
            won = list(pool.map(lambda k: (files.publish(f"state/{n}.json", f"{k} {n}"), k), range(8)))
        assert [f"{k} {n}" for ok, k in won if ok] == [files.read(f"state/{n}.json")]
    assert all(x.endswith(".json") for x in files.names("state") if not x.startswith("."))
