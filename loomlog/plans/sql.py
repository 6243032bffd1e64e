"""Pieces of SQL that several queries' SQL for DuckDB shares."""

#: A text without what stands in JSON strings, and what DuckDB takes for JSON beyond the standard: trailing commas and the names of numbers that are none.
BARE = """regexp_replace({0}, '"(?:[^"\\\\]|\\\\.)*"', '""', 'g')"""
BEYOND = r"',\s*[}\]]|[Nn]a[Nn]|[Ii]nf'"
#: The lines that are single JSON objects, as v with their value j.
VALID = f"""v as (select *, raw_line::json as j from (select *, {BARE.format('raw_line')} as bare from session_lines where json_valid(raw_line))
      where not regexp_matches(bare, {BEYOND}) and json_type(raw_line) = 'OBJECT')"""
#: The error records with their fields c and the reason why they are rejected, or null.
RECORDS = """records as (
        with r as (select *, raw_record as raw, regexp_replace(raw_record, '"[^"]*"', '"', 'g') as bare, regexp_extract_all(raw_record || ',', '("(?:[^"]|"")*"|[^",]*),', 1) as parts from error_records),
        f as (select *, list_transform(parts, lambda x: case when starts_with(x, '"') then replace(substr(x, 2, length(x) - 2), '""', '"') else x end) as c from r),
        k as (select *, list_transform(c, lambda x: regexp_full_match(x, '[0-9]+') and try_cast(x as bigint) is not null) as whole,
          list_transform(c, lambda x: regexp_full_match(x, '[0-9]{4}-[0-9]{2}-[0-9]{2}T(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]\\.[0-9]{3}Z') and try_cast(substr(x, 1, 10) as date) is not null) as moment from f)
        select *, case when raw is null then 'column_count' when (length(raw) - length(replace(raw, '"', ''))) % 2 = 1 or regexp_matches(bare, '[^,"]"|"[^,"]') then 'quoting'
          when length(bare) - length(replace(bare, ',', '')) <> 10 then 'column_count'
          when c[1] = '' or c[3] = '' or c[8] = '' or not (c[4] = '' or whole[4]) or not (c[5] = '' or whole[5]) or not (c[6] = '' or whole[6])
            or c[7] not in ('invalid_json', 'invalid_session_meta', 'read_error', 'not_file') or not moment[9] or not moment[10] or not whole[11] or regexp_full_match(c[11], '0+') then 'value' end as reason from k)"""
