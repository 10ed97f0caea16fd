"""The test tables seen as graph data: each view as a DataFrame and as the same SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgetide.functions.times import micros
from edgetide.operators.events import extract_fields, filter_events, with_time
from edgetide.plans.ordered import next_row, row_numbers
from edgetide.plans.sampling import STEPS
from edgetide.session import stored

SQL: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sql(*views: str, body: str) -> str:
    """``body`` behind the WITH clauses of ``views`` (in dependency order)."""
    head = ", ".join(f"{v} as ({SQL[v]})" for v in views)
    return f"with {head}{',' if body.lstrip().startswith('+') else ''} {body.lstrip().removeprefix('+')}"


def sql_draw(seed: int, *keys: str) -> str:
    texts = ", ".join(f"cast({k} as varchar)" for k in keys)
    return f"cast('0x' || substr(md5(concat_ws('|', '{seed}', {texts})), 1, 15) as bigint)"


def sql_uniform(seed: int, *keys: str) -> str:
    return f"(({sql_draw(seed, *keys)} >> 7) / 9007199254740992.0::double)"


def sql_permuted(j: str, size: str, seed: int, *keys: str) -> str:
    step = f"[{', '.join(map(str, STEPS))}][{sql_draw(seed, repr('step'), *keys)} % {len(STEPS)} + 1]"
    return f"((({step} % ({size}))::hugeint * ({j}) + {sql_draw(seed, *keys)} % ({size})) % ({size}))::bigint"


def sql_digest(seed: int, *keys: str) -> str:
    texts = ", ".join(f"cast({k} as varchar)" for k in keys)
    return f"md5(concat_ws('|', '{seed}', {texts}))"


def r6(column: str | Column, digits: int = 6) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("long")


# --- bipartite temporal graph: users and values
SQL["kv"] = """select event_id+1 as idx, user_id+1 as u, 100000+cast(json_extract_string(props,'$.k') as bigint) as i,
 epoch_us(ts) as ts_us, cast(event_type='error' as int) as label, event_type as action_type from events"""


def kv_edges(spark: SparkSession, folder: str) -> DataFrame:
    return kv_of(table(spark, folder, "events"))


def kv_of(events: DataFrame) -> DataFrame:
    return events.select(
        (F.col("event_id") + 1).alias("idx"), (F.col("user_id") + 1).alias("u"), (_k() + 100000).alias("i"),
        micros("ts").alias("ts_us"), (F.col("event_type") == "error").cast("int").alias("label"),
        F.col("event_type").alias("action_type"),
    )


# --- transitions between a user's consecutive values: a graph with paths
SQL["tr"] = """select * from (select event_id+1 as idx, k as u, lead(k) over (partition by user_id order by ts, event_id) as i,
 epoch_us(ts) as ts_us, cast(event_type='error' as int) as label, event_type as action_type
 from (select *, cast(json_extract_string(props,'$.k') as bigint)+1 as k from events)) where i is not null"""


def transition_edges(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select(
        (F.col("event_id") + 1).alias("idx"), (_k() + 1).alias("u"), micros("ts").alias("ts_us"),
        (F.col("event_type") == "error").cast("int").alias("label"), F.col("event_type").alias("action_type"), "user_id",
    )
    moved = next_row(events, ["user_id"], ["ts_us", "idx"], {"i": "u"}).where("i is not null")
    return moved.select("idx", "u", "i", "ts_us", "label", "action_type")


# transitions numbered densely by time, for operators that read edge numbers
SQL["trn"] = f"""select row_number() over (order by ts_us, idx) as idx, u, i, ts_us, label, action_type from ({SQL["tr"]})"""


def numbered_transitions(spark: SparkSession, folder: str) -> DataFrame:
    edges = transition_edges(spark, folder).withColumnRenamed("idx", "_old")
    return row_numbers(edges, ["ts_us", "_old"], "idx").select("idx", "u", "i", "ts_us", "label", "action_type")


# signatures: node type from the node id, some commands missing
SQL["nodes"] = """select distinct node as node_id, case node%3 when 0 then 'PROCESS' when 1 then 'FILE' else 'SHELL' end as object_type,
 '/n/' || node as path from (select u as node from tr union all select i from tr)"""
SQL["feat"] = """select idx, upper(action_type) as action_type, nullif(action_type, 'view') as command_line from tr"""
SQL["signed"] = """select tr.idx, u, i, ts_us, label, a.object_type as object_type_src, b.object_type as object_type_dst,
 feat.action_type, feat.command_line from tr join nodes a on a.node_id=u join nodes b on b.node_id=i join feat using (idx)"""

# the same edges with many different command lines, so that signatures are new at any time
SQL["rich"] = """select tr.idx, u, i, ts_us, label, a.object_type as object_type_src, b.object_type as object_type_dst,
 upper(action_type) as action_type, case when action_type <> 'view' then action_type || ' ' || (u*31 + i*17 + tr.idx%5) % 1009 end as command_line
 from tr join nodes a on a.node_id=u join nodes b on b.node_id=i"""


def rich_features_of(edges: DataFrame) -> DataFrame:
    number = (F.col("u") * 31 + F.col("i") * 17 + F.col("idx") % 5) % 1009
    command = F.when(F.col("action_type") != "view", F.concat("action_type", F.lit(" "), number.cast("string")))
    return edges.select("idx", F.upper("action_type").alias("action_type"), command.alias("command_line"))


def nodes_of(edges: DataFrame) -> DataFrame:
    ids = edges.select(F.explode(F.array("u", "i")).alias("node_id")).distinct()
    kind = F.when(F.col("node_id") % 3 == 0, "PROCESS").when(F.col("node_id") % 3 == 1, "FILE").otherwise("SHELL")
    return ids.select("node_id", kind.alias("object_type"), F.concat(F.lit("/n/"), "node_id").alias("path"))


def features_of(edges: DataFrame) -> DataFrame:
    return edges.select(
        "idx", F.upper("action_type").alias("action_type"), F.nullif("action_type", F.lit("view")).alias("command_line")
    )


# --- trades: many equal times
SQL["trade"] = """select row_number() over (order by l_shipdate,l_orderkey,l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice) as idx,
 o_custkey+1 as u, 1000000+l_suppkey as i, epoch_us(l_shipdate) as ts_us, cast(l_returnflag='R' as int) as label
 from lineitem join orders on l_orderkey=o_orderkey"""


TRADE_ORDER = ["ts_us", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def _trades(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    lines = table(spark, folder, "lineitem").join(orders, "l_orderkey")
    return lines.select(
        *TRADE_ORDER[1:], (F.col("o_custkey") + 1).alias("u"), (F.col("l_suppkey") + 1000000).alias("i"),
        micros("l_shipdate").alias("ts_us"), (F.col("l_returnflag") == "R").cast("int").alias("label"),
    )


def trade_edges(spark: SparkSession, folder: str) -> DataFrame:
    return row_numbers(_trades(spark, folder), TRADE_ORDER, "idx", keep=["u", "i", "ts_us", "label"]).select("idx", "u", "i", "ts_us", "label")


def unnumbered_trades(spark: SparkSession, folder: str) -> DataFrame:
    """``trade_edges`` for readers that don't ask for ``idx``: nothing is sorted."""
    return stored(_trades(spark, folder).select("u", "i", "ts_us", "label"))


# --- scored links with ties
SQL["scored"] = """select event_id+1 as idx, user_id+1 as src, 100000+cast(json_extract_string(props,'$.k') as bigint) as dst,
 value/(50.0+value) as score, epoch_us(ts) as ts_us, cast(event_type='error' as int) as label from events"""


def scored_links(spark: SparkSession, folder: str) -> DataFrame:
    return scored_of(table(spark, folder, "events"))


def scored_of(events: DataFrame) -> DataFrame:
    return events.select(
        (F.col("event_id") + 1).alias("idx"), (F.col("user_id") + 1).alias("src"), (_k() + 100000).alias("dst"),
        (F.col("value") / (F.lit(50.0) + F.col("value"))).alias("score"), micros("ts").alias("ts_us"),
        (F.col("event_type") == "error").cast("int").alias("label"),
    )


# --- raw audit records
SQL["logs"] = r"""select event_id as ord, cast(event_id as varchar) as id, 'Host' || cast(user_id%5 as varchar) as hostname,
 strftime(ts,'%Y-%m-%dT%H:%M:%S.%g') || '+00:00' as timestamp, epoch_us(date_trunc('millisecond', ts)) as ts_us,
 'p' || cast(user_id as varchar) as actor_id,
 case when event_type in ('click','view') then 'PROCESS' when event_type in ('purchase','signup') then 'FILE' else 'SHELL' end as object_type,
 case when event_type in ('click','view') then 'p' else 'o' end || k as object_id,
 case event_type when 'click' then 'READ' when 'view' then 'CREATE' when 'purchase' then 'WRITE' when 'signup' then 'START' else 'TERMINATE' end as action_type,
 case when event_id%7<>0 then 'C:\Windows\p' || user_id || '.exe' end as image_path,
 case when user_id%2=0 then 'C:\Users\bob\run' || user_id%7 || '.exe' else 'C:\Windows\svc' || user_id%7 || '.exe' end as parent_image_path,
 case when event_type in ('click','view') then 'c:\users\u' || user_id || '\run.exe /d ' || k || ' 10.0.0.' || k || ' 0x' || k end as command_line,
 case when event_type in ('purchase','signup') and event_id%5<>0 then '\Device\HarddiskVolume1\Users\u' || user_id || '\f' || k || '.txt' end as file_path,
 case when event_type='error' and event_id%2=0 then 'Host ID = h' || user_id || chr(10) || 'User = u' || k || chr(10) || 'Command Name = c' end as context_info,
 case when user_id%3<>0 then 'S-1-5-' || (18 + user_id%4) end as sid, cast(user_id as varchar) as pid, k as ppid,
 case user_id%5 when 0 then 'NT AUTHORITY\SYSTEM' when 1 then 'SYSTEMIA.COM\u' when 2 then 'Window Manager\DWM-1' when 3 then 'Font Driver Host\UMFD-1' else 'guest' end as principal
 from (select *, json_extract_string(props,'$.k') as k from events)"""


def raw_logs(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as nested audit records, with ``ord`` as input order."""
    kind, user, number = F.col("event_type"), F.col("user_id"), F.col("event_id")
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    k = F.get_json_object("props", "$.k")
    process, file, shell = kind.isin("click", "view"), kind.isin("purchase", "signup"), kind == "error"
    user_text = user.cast("string")
    image = F.when(number % 7 != 0, text("C:\\Windows\\p", user_text, ".exe"))
    parent = F.when(user % 2 == 0, text("C:\\Users\\bob\\run", (user % 7).cast("string"), ".exe")).otherwise(
        text("C:\\Windows\\svc", (user % 7).cast("string"), ".exe"))
    command = F.when(process, text("c:\\users\\u", user_text, "\\run.exe /d ", k, " 10.0.0.", k, " 0x", k))
    path = F.when(file & (number % 5 != 0), text("\\Device\\HarddiskVolume1\\Users\\u", user_text, "\\f", k, ".txt"))
    context = F.when(shell & (number % 2 == 0), text("Host ID = h", user_text, "\nUser = u", k, "\nCommand Name = c"))
    sid = F.when(user % 3 != 0, text("S-1-5-", (user % 4 + 18).cast("string")))
    action = (
        F.when(kind == "click", "READ").when(kind == "view", "CREATE").when(kind == "purchase", "WRITE")
        .when(kind == "signup", "START").otherwise("TERMINATE")
    )
    principal = (
        F.when(user % 5 == 0, "NT AUTHORITY\\SYSTEM").when(user % 5 == 1, "SYSTEMIA.COM\\u")
        .when(user % 5 == 2, "Window Manager\\DWM-1").when(user % 5 == 3, "Font Driver Host\\UMFD-1").otherwise("guest")
    )
    moment = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    none = F.lit(None).cast("string")
    return table(spark, folder, "events").select(
        number.alias("ord"), number.cast("string").alias("id"), text("Host", (user % 5).cast("string")).alias("hostname"),
        text(moment, "+00:00").alias("timestamp"), text("p", user_text).alias("actorID"),
        text(F.when(process, "p").otherwise("o"), k).alias("objectID"),
        F.when(process, "PROCESS").when(file, "FILE").otherwise("SHELL").alias("object"), action.alias("action"),
        user_text.alias("pid"), k.alias("ppid"), principal.alias("principal"),
        F.struct(
            image.alias("image_path"), parent.alias("parent_image_path"), command.alias("command_line"),
            path.alias("file_path"), none.alias("new_path"), none.alias("module_path"), none.alias("key"),
            none.alias("dest_ip"), none.alias("dest_port"), context.alias("context_info"), sid.alias("sid"),
            none.alias("size"),
        ).alias("properties"),
    )


def flat_events(spark: SparkSession, folder: str) -> DataFrame:
    """Filtered, flat and timed events with ``ord``."""
    logs = raw_logs(spark, folder)
    return with_time(filter_events(extract_fields(logs).withColumn("ord", F.col("id").cast("long"))))


SQL["malicious"] = "select lower(hostname) as hostname, id from logs where action_type='TERMINATE' and ord%3=0"


def malicious_ids(events: DataFrame) -> DataFrame:
    bad = events.where((F.col("action_type") == "TERMINATE") & (F.col("ord") % 3 == 0))
    return bad.select(F.lower("hostname").alias("hostname"), "id")


# exact time quantiles used as split points
SQL["cuts"] = "select quantile_cont(ts_us,0.7) as tv, quantile_cont(ts_us,0.85) as tt from kv"
