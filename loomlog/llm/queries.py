"""The queries p3, p5, p8, p9 and p10, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm import conversations, encoding, mixing, secrets, splitting
from loomlog.operators import instants
from loomlog.tables import stored, table


def _texts(spark: SparkSession, d: str) -> DataFrame:
    def of(name: str, key: str, text: str) -> DataFrame:
        return table(spark, d, name).select(F.lit(name).alias("origin"), F.col(key).alias("row_id"), F.col(text).alias("text"))

    return of("file_timelines", "backup_id", "content").unionByName(of("chat_messages", "row_id", "content")).unionByName(of("preference_examples", "example_id", "proposal_content"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return secrets.places(_texts(spark, d))


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    return secrets.redacted(_texts(spark, d))


def p3_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Each credential with how it was found and whether it has its issuer's checksum."""
    return secrets.kinds(_texts(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.turns(table(spark, d, "chat_messages"), stored).select("session_id", "turn_no", "uuid")


def p5_turns(spark: SparkSession, d: str) -> DataFrame:
    """The turns with written and corrected instants, and their place in the merge by time."""
    messages = table(spark, d, "chat_messages")
    raw = messages.where("uuid is not null").select("session_id", "uuid", F.col("event_ts").alias("raw"), F.coalesce("tz_name", F.lit("UTC")).alias("zone"))
    stamps = raw.join(instants.dictionary(raw, stored), ["raw", "zone"]).where("instant_us is not null").select("session_id", "uuid", "instant_us", conversations.precision_us(F.col("raw")).alias("width_us"))
    rows = conversations.trees(messages, stored)
    return conversations.merged(stored(conversations.turns_of(rows), "turns"), conversations.answered(rows, stored), stamps, stored)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.ids(table(spark, d, "documents"))


def _mixed(spark: SparkSession, d: str):
    sizes = stored(encoding.sizes(table(spark, d, "documents")), "sizes")
    return mixing.mix(sizes, table(spark, d, "mix_targets"), stored)


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The used documents of each mix with their number of uses."""
    return _mixed(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share of the tokens that each source really has."""
    return mixing.shares(*_mixed(spark, d))


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    limits = table(spark, d, "split_limits").orderBy("limit_name").collect()  # a fixed table
    return splitting.split(table(spark, d, "documents"), [(r["limit_name"], r["tokenizer_name"], r["max_tokens"], r["overlap_tokens"]) for r in limits])


QUERIES = {f.__name__: f for f in (p3_found, p3_redacted, p3_kinds, p5_found, p5_turns, p8_ids, p9_mix, p9_shares, p10_pieces)}
ORACLE_SQL: dict[str, str] = {
    "p5_found": """with recursive m as (
        select session_id as s, uuid as id, min(parent_uuid) as p, min(seq) as seq, min(case when regexp_full_match(coalesce(content, ''), '\\s*') then null
          when trim(lower(msg_role)) in ('user', 'human') then 'user' when trim(lower(msg_role)) in ('assistant', 'model', 'gemini', 'ai') then 'assistant'
          when trim(lower(msg_role)) in ('tool', 'toolresult') then 'tool' when trim(lower(msg_role)) = 'system' then 'system' end) as who
        from chat_messages where uuid is not null group by session_id, uuid),
      w as (
        select s, id, who, [{'seq': seq, 'id': id}] as path from m where p is null
        union all select m.s, m.id, m.who, list_append(w.path, {'seq': m.seq, 'id': m.id}) from m join w on m.s = w.s and m.p = w.id),
      ordered as (select s, id, who, path, row_number() over (partition by s order by path) as n, len(path) as depth from w),
      ends as (select a.s, a.id, min(b.n) as stop from ordered a left join ordered b on b.s = a.s and b.n > a.n and b.depth <= a.depth where a.who = 'user' group by a.s, a.id),
      answered as (select a.s, a.id, bool_or(b.n is not null) as ok from ordered a join ends e on e.s = a.s and e.id = a.id
        left join ordered b on b.s = a.s and b.who = 'assistant' and b.n > a.n and (e.stop is null or b.n < e.stop) group by a.s, a.id),
      kept as (
        select m.s from m left join m as u on u.s = m.s and u.id = m.p left join w on w.s = m.s and w.id = m.id left join answered a on a.s = m.s and a.id = m.id
        group by m.s having count(*) filter (m.p is null) = 1 and count(*) filter (m.p is not null and u.id is null) = 0 and count(*) filter (w.id is null) = 0
        and count(*) filter (m.who = 'user') > 0 and count(*) filter (m.who = 'user' and not coalesce(a.ok, false)) = 0)
      select s as session_id, row_number() over (partition by s order by n) as turn_no, id as uuid from ordered join kept using (s) where who is not null""",
}
