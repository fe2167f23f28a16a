"""Readers of text formats: notes with front matter, journals, org calendars, vCards, mailboxes, chat exports, tables.

Every reader starts from Spark's file sources (one row per file or line, listed and split by Spark) and stays inside the
JVM but for formats that only the standard library parses (MIME mail, YAML front matter), which go through Arrow batches.
"""

from __future__ import annotations

import json
import re
from email import message_from_string, policy
from email.utils import getaddresses

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.operators.mail import kept_mails
from kinweave.operators.text import interaction_kind, shortened, wiki_links, with_context, without_links

INTERACTION = ["contact", "date", "channel", "interaction_type", "summary", "source", "context", "metadata"]
# What a heading of an org file may begin with.
HEADING_STATES = ["TODO", "DONE", "NEXT", "WAITING"]


def whole_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, name, text) of each file below path whose name matches pattern."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.regexp_replace("value", "\r", "").alias("text"))


def space_of(path: Column) -> Column:
    """The top folder of the form 1-name that a file lies in."""
    return F.nullif(F.regexp_extract(path, r"/(\d+-[^/]+)/", 1), F.lit(""))


def likely_contact(name: Column) -> Column:
    """Names with a capital that are no date, file, tag or single plain word."""
    return name.rlike("[A-Z]") & ~name.rlike(r"^\d{4}-\d{2}-\d{2}$|^#|(?i)^[a-z_]+$") & (name != ".md")


def journal_interactions(spark: SparkSession, path: str, since: str, until: str) -> DataFrame:
    """One interaction per wiki link to a likely contact in the journal files YYYY-MM-DD.md of the days since..until.

    context is the line with its neighbours. Files of other days are left out before their lines are read apart.
    """
    day = F.when(F.length("name") == 13, F.left("name", F.lit(10)))
    files = whole_files(spark, path, "*.md").withColumn("date", F.when(F.try_to_date(day, "yyyy-MM-dd").isNotNull(), day)).where(F.col("date").between(since, until))
    rows = with_context(files.select(F.struct("path", "date").alias("f"), "text"), "f", "text")
    links = rows.select("f.*", "line_no", "line", "context", F.explode(wiki_links(F.col("line"))).alias("contact")).where(likely_contact(F.col("contact")))
    summary = shortened(F.trim(F.trim(without_links(F.col("line"))), F.lit("*- \t")))
    return links.select("contact", "date", F.lit("journal").alias("channel"), interaction_kind(F.col("line")).alias("interaction_type"), summary.alias("summary"), F.concat_ws(":", "path", F.col("line_no").cast("string")).alias("source"), "context", F.create_map().cast("map<string,string>").alias("metadata"))


def _stamp(line: Column) -> tuple[Column, Column, Column]:
    """Date, begin and end of the first <...> of an org line: blank-separated parts, the first a date, one with a colon the hours."""
    parts = F.split(F.substring_index(F.substring_index(F.substring(line, F.instr(line, "<"), F.length(line)), ">", 1), "<", -1), r"\s+")
    day = F.get(parts, F.lit(0))
    hours = F.split(F.get(F.filter(parts, lambda x: F.contains(x, F.lit(":"))), F.lit(0)), "-")
    dated = F.contains(line, F.lit("<")) & F.contains(line, F.lit(">")) & (F.length(day) == 10) & F.try_to_date(day, "yyyy-MM-dd").isNotNull()
    return F.when(dated, day), F.get(hours, F.lit(0)), F.get(hours, F.lit(1))


def heading_title(heading: Column) -> Column:
    """An org heading without its state, its tags and the brackets of its links."""
    words = F.split(F.trim(heading), " ")
    words = F.when(F.get(words, F.lit(0)).isin(HEADING_STATES), F.slice(words, 2, F.size(words))).otherwise(words)
    last = F.try_element_at(words, F.lit(-1))
    words = F.when(F.startswith(last, F.lit(":")) & F.endswith(last, F.lit(":")), F.slice(words, 1, F.size(words) - 1)).otherwise(words)
    return F.trim(without_links(F.array_join(words, " ")))


def calendar_interactions(spark: SparkSession, path: str, since: str, until: str) -> DataFrame:
    """One meeting per link in the heading above each timestamp line of the org files below path."""
    rows = with_context(whole_files(spark, path, "*.org").select("path", "text"), "path", "text")
    stars = F.rtrim(F.substring_index("line", " ", 1))
    own = F.when((F.translate(stars, "*", "") == "") & (stars != "") & F.contains("line", F.lit(" ")), F.trim(F.expr("substring(line, instr(line, ' ') + 1)")))
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("is_heading", own.isNotNull()).withColumn("heading", F.last(F.when(own.isNotNull(), F.struct(own.alias("text"), F.col("line_no").alias("at"))), ignorenulls=True).over(w))
    day, begin, end = _stamp(F.col("line"))
    timed = rows.where(~F.col("is_heading") & F.col("heading").isNotNull()).withColumns({"date": day, "begin": begin, "end": end}).where(F.col("date").between(since, until))
    people = timed.select("*", F.explode(wiki_links(F.col("heading.text"))).alias("contact")).where(likely_contact(F.col("contact")))
    return people.select("contact", "date", F.lit("calendar").alias("channel"), F.lit("meeting").alias("interaction_type"), heading_title(F.col("heading.text")).alias("summary"), F.concat_ws(":", "path", F.col("heading.at").cast("string")).alias("source"), "context", F.create_map(F.lit("start_time"), F.col("begin"), F.lit("end_time"), F.col("end")).alias("metadata"))


#: The readers of interactions by name: reader(spark, path, since, until). Register further ones here.
READERS = {"journal": journal_interactions, "calendar": calendar_interactions}


def scan_all(spark: SparkSession, paths: dict[str, str], now: str, days: int | dict[str, int] = 30) -> DataFrame:
    """The interactions of every named reader over its own path and window of days up to now, as one table."""
    from datetime import date, timedelta

    end = date.fromisoformat(now)
    back = lambda name: days[name] if isinstance(days, dict) else days
    return all_interactions({name: READERS[name](spark, path, (end - timedelta(days=back(name))).isoformat(), now) for name, path in paths.items()})


def all_interactions(parts: dict[str, DataFrame]) -> DataFrame:
    """The interactions of several readers as one table."""
    frames = [p.select(*INTERACTION) for p in parts.values()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _front_matter(text: str) -> tuple[dict, str]:
    if not text.startswith("---"):
        return {}, text
    pieces = text.split("---", 2)
    if len(pieces) < 3:
        return {}, text
    try:
        import yaml

        found = yaml.safe_load(pieces[1])
    except ImportError:
        found = dict(re.findall(r"(?m)^([\w-]+):[ \t]*(.*)$", pieces[1]))
    except Exception:
        return {}, text
    return (found if isinstance(found, dict) else {}), pieces[2]


@F.pandas_udf(T.StructType([T.StructField("fields", T.MapType(T.StringType(), T.StringType())), T.StructField("body", T.StringType())]))
def front_matter(texts: pd.Series) -> pd.DataFrame:
    """The front matter of notes as a map of texts (lists and maps as JSON), and the rest of the note."""
    rows = []
    for text in texts:
        fields, body = _front_matter(text or "")
        rows.append(({str(k): v if isinstance(v, str) else None if v is None else json.dumps(v, default=str) if isinstance(v, (list, dict)) else str(v) for k, v in fields.items()}, body))
    return pd.DataFrame(rows, columns=["fields", "body"])


def notes(spark: SparkSession, path: str, keep_invalid: bool = True, skip_templates: bool = False) -> DataFrame:
    """(path, space, name, contact_type, status, fields, body) of the Markdown notes below path.

    keep_invalid: notes without front matter stay, with the file's name and status `draft`. skip_templates: files whose
    name starts with an underscore are left out.
    """
    files = whole_files(spark, path, "*.md")
    if skip_templates:
        files = files.where(~F.col("name").startswith("_"))
    read = files.withColumn("n", front_matter("text"))
    if not keep_invalid:
        read = read.where(F.size("n.fields") > 0)
    field = lambda k: F.try_element_at("n.fields", F.lit(k))
    kind = F.coalesce(field("contact_type"), field("entity_type"), F.when(F.contains("path", F.lit("/companies/")), "company").otherwise("person"))
    stem = F.regexp_replace(F.col("name"), r"\.md$", "")
    return read.select("path", space_of(F.col("path")).alias("space"), F.coalesce(field("name"), stem).alias("name"), kind.alias("contact_type"), F.coalesce(field("status"), F.lit("draft")).alias("status"), F.col("n.fields").alias("fields"), F.col("n.body").alias("body"))


def vcards(spark: SparkSession, path: str) -> DataFrame:
    """name, emails, phones, organization, role, uid, addresses, urls, notes, photo and source of each card of the .vcf files below path.

    Folded lines are joined, parameters of a field give its type; a card without a name of any kind is left out. photo is
    the binary of an inline picture; source is told by the product that wrote the card or by its fields.
    """
    text = F.regexp_replace("text", r"\n[ \t]", "")
    cards = whole_files(spark, path, "*.vcf").select("path", F.posexplode(F.regexp_extract_all(text, F.lit(r"(?is)BEGIN:VCARD\n(.*?)\nEND:VCARD"), F.lit(1))).alias("card_no", "card"))
    fields = F.transform(F.split("card", "\n"), lambda x: F.struct(F.upper(F.regexp_extract(x, r"^(?:[^.:;]*\.)?([^:;]+)", 1)).alias("key"), F.upper(F.regexp_extract(x, r"(?i)TYPE=([^;:,]+)", 1)).alias("type"), F.regexp_extract(x, r"^[^:]*:(.*)$", 1).alias("value")))
    read = cards.withColumn("f", fields)
    one = lambda key: F.nullif(F.trim(F.get(F.filter("f", lambda x: x.key == key), F.lit(0)).value), F.lit(""))
    many = lambda key: F.transform(F.filter("f", lambda x: x.key == key), lambda x: F.struct(x.type.alias("type"), F.trim(x.value).alias("value")))
    built = F.trim(F.concat_ws(" ", F.get(F.split(one("N"), ";"), F.lit(1)), F.get(F.split(one("N"), ";"), F.lit(0))))
    place = lambda x: F.struct(x.type.alias("type"), *[F.trim(F.get(F.split(x.value, ";"), F.lit(i))).alias(part) for i, part in ((2, "street"), (3, "city"), (4, "region"), (5, "code"), (6, "country"))])
    low = F.lower("card")
    source = F.when(low.contains("google") | low.contains("gmail"), "gmail").when(low.contains("apple") | low.contains("x-ab"), "apple").otherwise("unknown")
    out = read.select(
        "path", "card_no", F.coalesce(one("FN"), F.nullif(built, F.lit(""))).alias("name"), many("EMAIL").alias("emails"), many("TEL").alias("phones"), F.get(F.split(one("ORG"), ";"), F.lit(0)).alias("organization"), one("TITLE").alias("role"), one("UID").alias("uid"),
        F.transform(F.filter("f", lambda x: x.key == "ADR"), place).alias("addresses"), F.transform(many("URL"), lambda x: x.value).alias("urls"), F.regexp_replace(one("NOTE"), r"\\n", "\n").alias("notes"), F.expr("try_to_binary(nullif(trim(get(filter(f, x -> x.key = 'PHOTO'), 0).value), ''), 'base64')").alias("photo"), source.alias("source"),
    )
    return out.where("name IS NOT NULL")


def located(addresses: Column) -> Column:
    """City and country of the work address, else of the first."""
    work = F.get(F.filter(addresses, lambda a: F.upper(a.type) == "WORK"), F.lit(0))
    chosen = F.coalesce(work, F.get(addresses, F.lit(0)))
    return F.concat_ws(", ", F.nullif(chosen.city, F.lit("")), F.nullif(chosen.country, F.lit("")))


MAIL = "message_id string, thread_id string, from_email string, from_name string, to_emails array<string>, cc_emails array<string>, date string, subject string, snippet string, fault string"


def _snippet(message) -> str | None:
    part = message.get_body(preferencelist=("plain", "html"))
    if part is None:
        return None
    try:
        text = part.get_content()
    except Exception:
        return None
    if part.get_content_type() == "text/html":
        text = re.sub(r"<[^>]*>", " ", text)
    kept = []
    for line in text.split("\n"):
        bare = line.strip()
        if bare in ("--", "---", "- --") or (bare.startswith("___") and not bare.strip("_")) or re.match(r"-+ ?(Forwarded|Original) Message", bare, re.IGNORECASE):
            break
        if not bare.startswith(">"):
            kept.append(line)
    return " ".join(" ".join(kept).split())[:500]


def _parsed(raw: str) -> tuple | None:
    """One mail as a row of MAIL; None for one without a sender's address."""
    m = message_from_string(raw.split("\n", 1)[1] if raw.startswith(("From ", "- ")) or "\n" in raw else raw, policy=policy.default)
    sender = getaddresses([str(m["From"] or "")])[0]
    mid = (str(m["Message-ID"]) if m["Message-ID"] else "").strip()
    refs = re.findall(r"<[^>]+>", str(m["References"] or ""))
    thread = str(m["X-GM-THRID"] or "") or (refs[0] if refs else "") or str(m["In-Reply-To"] or "").strip() or mid
    people = lambda h: [a.lower() for _, a in getaddresses([str(x) for x in m.get_all(h, [])]) if "@" in a]
    if "@" not in sender[1]:
        return None
    return (mid or None, thread or None, sender[1].lower(), sender[0] or sender[1].split("@")[0], people("To"), people("Cc"), str(m["Date"]) if m["Date"] else None, str(m["Subject"] or ""), _snippet(m), None)


def all_mails(spark: SparkSession, path: str) -> DataFrame:
    """The records of mbox files, one row each: a mail, or with `fault` what kept it from being read."""
    columns = [c.split()[0] for c in MAIL.split(", ")]

    def parse(batches):
        for batch in batches:
            rows = []
            for raw in batch["value"]:
                try:
                    row = _parsed(raw)
                    rows.append(row or (None,) * 9 + ("no sender",))
                except Exception as e:
                    rows.append((None,) * 9 + (type(e).__name__,))
            yield pd.DataFrame(rows, columns=columns)

    raw = spark.read.option("lineSep", "\nFrom ").text(path).where(F.length("value") > 0)
    return raw.mapInPandas(parse, MAIL)


def mailboxes(spark: SparkSession, path: str, excluded: list[str] | None = None, sensitive: list[str] = ()) -> DataFrame:
    """The mails of mbox files; those that cannot be read are counted by mail_faults.

    excluded: shell patterns of domains. With it the whole filter chain applies: only mails of personal senders outside
    these domains stay, with the column sensitive, and sensitive ones keep no snippet.
    """
    mails = all_mails(spark, path).where("fault IS NULL").drop("fault")
    if excluded is None:
        return mails
    kept = kept_mails(mails, excluded, list(sensitive))
    return kept.withColumn("snippet", F.when(~F.col("sensitive"), F.col("snippet")))


def mail_faults(spark: SparkSession, path: str) -> DataFrame:
    """(fault, n): how many records of mbox files could not be read, and why."""
    return all_mails(spark, path).where("fault IS NOT NULL").groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


def chat_messages(spark: SparkSession, path: str) -> DataFrame:
    """chat, chat_type, n, sender, date, text of a chat export (chats.list[].messages[]); rich texts are flattened."""
    shape = "chats struct<list: array<struct<name:string,type:string,id:long,messages:array<struct<`from`:string,date:string,text:string>>>>>"
    raw = spark.read.schema(shape).option("multiLine", True).json(path)
    chats = raw.select(F.explode("chats.list").alias("c"))
    rows = chats.select(F.col("c.name").alias("chat"), F.col("c.type").alias("chat_type"), F.posexplode("c.messages").alias("n", "m"))
    flat = F.when(F.col("m.text").startswith("["), F.array_join(F.transform(F.from_json("m.text", "array<string>"), lambda x: F.coalesce(F.get_json_object(x, "$.text"), x)), "")).otherwise(F.col("m.text"))
    return rows.select("chat", "chat_type", F.col("n").cast("long").alias("n"), F.col("m.from").alias("sender"), F.col("m.date").alias("date"), flat.alias("text"))


def pipe_tables(spark: SparkSession, path: str, columns: list[str], header: str | None = None) -> DataFrame:
    """Rows of Markdown pipe tables: the named first columns, further cells joined as notes; rules and rows without a first cell are left out.

    A row right above a rule is a header and no data. header: the first cell of a header, which leaves out those rows too
    in tables that are split over files.
    """
    lines = with_context(whole_files(spark, path).select("path", "text"), "path", "text", most=1_000_000)
    rule = r"^[\s|:-]*-[\s|:-]*$"
    after = F.expr("substring(context, length(line) + instr(context, line) + 1)")
    rows = lines.where(F.col("line").rlike(r"^\s*\|") & ~F.col("line").rlike(rule)).where(~(after.rlike(rule) & after.startswith("|")))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    cut = rows.select(cells.alias("c"))
    named = [F.get("c", F.lit(i)).alias(c) for i, c in enumerate(columns)]
    rest = F.array_join(F.slice("c", len(columns) + 1, F.size("c")), " ").alias("notes")
    first = F.get("c", F.lit(0))
    return cut.where((first != "") & (F.lit(True) if header is None else first != header)).select(*named, rest)


def report_contacts(spark: SparkSession, path: str) -> DataFrame:
    """(name, entity_type, status, group_name, messages, note) of reports: `### Name (type)`, `**Status:** x`, `- Group (N messages) - NOTE: x`.

    One row per group of a contact. A report's lines are in the order of the file, so a contact's lines follow its heading.
    """
    lines = with_context(whole_files(spark, path, "*.md").select("path", "text"), "path", "text")
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.startswith("line", F.lit("### ")), F.struct(F.trim(F.regexp_extract("line", r"^### (.*?)(?:\(([^()]*)\))?\s*$", 1)).alias("name"), F.nullif(F.regexp_extract("line", r"\(([^()]*)\)\s*$", 1), F.lit("")).alias("entity_type"), F.col("line_no").alias("at")))
    owned = lines.withColumn("h", F.last(head, ignorenulls=True).over(w)).where("h IS NOT NULL")
    status = owned.where(F.startswith("line", F.lit("**Status:**"))).groupBy("path", "h.at").agg(F.first(F.trim(F.substring_index("line", ":**", -1))).alias("status"))
    item = r"^- (.*) \((\d+) messages\)(?: - NOTE: (.*))?$"
    groups = owned.where(F.col("line").rlike(item)).select("path", "h.*", F.regexp_extract("line", item, 1).alias("group_name"), F.regexp_extract("line", item, 2).cast("long").alias("messages"), F.nullif(F.regexp_extract("line", item, 3), F.lit("")).alias("note"))
    return groups.join(status, ["path", "at"], "left").select("name", "entity_type", "status", "group_name", "messages", "note")
