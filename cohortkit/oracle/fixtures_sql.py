"""DuckDB SQL for the fixture views (same rules as ``sources.fixtures``).

Each entry is a CTE body over the pre-registered test tables.  ``with_ctes``
assembles a ``WITH`` clause holding a CTE and everything it depends on.
"""

from __future__ import annotations

RATING = ("CASE WHEN l_partkey % 3 = 0 THEN NULL "
          "WHEN (l_partkey + l_linenumber) % 97 = 0 THEN CAST(2 AS DOUBLE) "
          "ELSE CAST(4 + l_linenumber % 2 AS DOUBLE) END")
STATUS = "CASE WHEN l_returnflag = 'N' THEN 'cancelled' ELSE 'dropped' END"
CHAT = ("CASE WHEN (l_partkey + l_orderkey) % 211 = 0 THEN 'rude behavior' "
        "WHEN l_partkey % 5 = 0 THEN 'No issue' END")
REVIEW = ("CASE WHEN (l_orderkey + 7 * l_linenumber + l_partkey) % 9 = 0 THEN 'L2_MEDIUM' "
          "WHEN (l_orderkey + l_partkey) % 307 = 1 THEN 'L0_HIGHEST_THREAT' "
          "WHEN (l_orderkey + l_partkey) % 307 < 4 THEN 'L1_HIGH_CONCERN' "
          "WHEN l_partkey % 7 = 0 THEN 'L3_POSITIVE' END")


def TICKET(below: int) -> str:
    return (f"CASE WHEN (3 * l_orderkey + l_partkey) % 251 < {below} "
            "THEN 'P' || CAST(l_partkey % 4 AS VARCHAR) END")


LIVE = "CASE WHEN l_orderkey % 23 = 0 THEN 'No' ELSE 'Yes' END"
RATE = ("CASE WHEN l_orderkey % 17 = 0 THEN 'No' WHEN l_orderkey % 2 = 0 THEN 'Yes, I felt safe!' "
        "ELSE 'Yes' END")

CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "f_rides": ("""
    SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, l.l_returnflag, l.l_linestatus,
           l.l_shipdate, o.o_custkey, s.s_nationkey, r.r_name,
           CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) AS oid,
           CAST(l.l_suppkey AS VARCHAR) AS cap,
           strftime(CAST(l.l_shipdate AS DATE), '%Y%m%d') AS day,
           CAST(date_diff('day', DATE '1970-01-01', CAST(l.l_shipdate AS DATE)) AS BIGINT) * 86400 AS ep
    FROM lineitem l
    JOIN orders o ON l.l_orderkey = o.o_orderkey
    JOIN supplier s ON l.l_suppkey = s.s_suppkey
    JOIN nation n ON s.s_nationkey = n.n_nationkey
    JOIN region r ON n.n_regionkey = r.r_regionkey""", ()),
    "t1": (f"""
    SELECT oid AS order_id, l_shipdate AS order_date, cap AS captain_id,
           CAST(o_custkey AS VARCHAR) AS customer_id,
           CAST(CASE WHEN o_custkey % 29 = 0 THEN 2 ELSE o_custkey % 2 END AS INTEGER) AS customer_obj_gender,
           r_name AS city_name, {RATING} AS customer_feedback_rating,
           ep AS started_epoch, CASE WHEN l_partkey % 3 <> 0 THEN ep + 3600 END AS customer_rated_epoch,
           ep + 1800 AS dropped_epoch, {STATUS} AS order_status, day AS yyyymmdd,
           CASE WHEN l_partkey % 13 = 0 THEN 'auto' ELSE 'link' END AS service_category, r_name AS city
    FROM f_rides""", ("f_rides",)),
    "t2": ("""
    SELECT CAST(user_id AS VARCHAR) AS riderinfo__userid,
           CASE event_type WHEN 'purchase' THEN 'Bike Rated by Women,Link' WHEN 'view' THEN 'Scooty'
                WHEN 'click' THEN 'Bike' WHEN 'error' THEN 'Link' WHEN 'signup' THEN 'Auto' END
             AS riderinfo__servicenames,
           ts AS updated_epoch
    FROM events""", ()),
    "t3": ("""
    SELECT CAST(e.user_id AS VARCHAR) AS _id, 'SHIFT_' || CAST(e.event_id % 6 AS VARCHAR) AS shift_name,
           '000-' || CAST(e.user_id AS VARCHAR) AS mobile, r.r_name AS city, e.ts AS created_on,
           e.event_id % 5 <> 0 AS active
    FROM events e
    JOIN supplier s ON e.user_id = s.s_suppkey
    JOIN nation n ON s.s_nationkey = n.n_nationkey
    JOIN region r ON n.n_regionkey = r.r_regionkey""", ()),
    "t4": ("""
    SELECT CAST(s_suppkey AS VARCHAR) AS captain_id,
           CASE WHEN s_suppkey % 12 = 11 THEN 'mode_other' ELSE 'mode_link' END AS mode_id
    FROM supplier""", ()),
    "t5": ("""
    SELECT oid AS order_id, cap AS captain_id,
           CASE WHEN l_linestatus = 'F' THEN 'customer_cancelled'
                WHEN l_partkey % 41 = 0 THEN 'RIDER_CANCELLED' ELSE 'rider_cancelled' END AS event_type,
           CASE WHEN o_custkey % 31 = 0 THEN 'unknown' WHEN o_custkey % 2 = 1 THEN 'Female'
                ELSE 'male' END AS customer_gender,
           day AS yyyymmdd, r_name AS city, 'Link' AS service
    FROM f_rides WHERE l_returnflag = 'N'""", ("f_rides",)),
    "t6": ("""
    SELECT oid AS eventprops__orderid, oid || '-' || CAST(g.n AS VARCHAR) AS eventid,
           day AS yyyymmdd, r_name AS eventprops__city
    FROM f_rides CROSS JOIN (SELECT range AS n FROM range(0, 7)) g
    WHERE (l_partkey + o_custkey % 2) % 4 = 0 AND g.n <= (l_orderkey % 7) * (l_linenumber % 2)""",
           ("f_rides",)),
    "tx": ("""
    SELECT f.*, v.typ,
           f.oid || '|' || CAST(f.l_partkey AS VARCHAR) || '|' || v.typ AS row_id
    FROM f_rides f CROSS JOIN (VALUES ('chat'), ('Support_Ticket'), ('post_ride_review')) v(typ)""",
           ("f_rides",)),
    "t8": ("""
    SELECT row_id, r_name AS city_name, day AS yyyymmdd, oid AS order_id, cap AS captain_id,
           typ AS input_type
    FROM tx""", ("tx",)),
    "t7": (f"""
    SELECT row_id, day AS yyyymmdd,
           CASE WHEN typ = 'chat' THEN ({CHAT})
                WHEN typ = 'Support_Ticket' THEN ({TICKET(4)})
                ELSE ({REVIEW}) END AS response__issue_type
    FROM tx""", ("tx",)),
    "t9": ("""
    SELECT CASE n_nationkey % 4 WHEN 0 THEN 'Link' WHEN 1 THEN 'Scooty' WHEN 2 THEN 'Bike Rated by Women'
                ELSE 'Auto' END AS service_level,
           r_name AS city_display_name, 'sd' || CAST(n_nationkey AS VARCHAR) AS service_detail_id
    FROM nation JOIN region ON n_regionkey = r_regionkey""", ()),
    "t10": ("""
    SELECT CAST(c_custkey AS VARCHAR) AS _id, CAST(c_custkey % 3 AS INTEGER) AS gender FROM customer""", ()),
    "t11": (f"""
    SELECT oid AS data__orderid, l_shipdate AS eventtime, 'text_' || CAST(l_partkey AS VARCHAR) AS data__text,
           CASE WHEN l_partkey % 6 = 0 THEN ({LIVE}) ELSE ({RATE}) END AS data__feedback,
           CAST(o_custkey AS VARCHAR) AS data__customerid,
           'sd' || CAST(s_nationkey AS VARCHAR) AS data__servicedetail,
           CASE WHEN l_partkey % 6 = 0 THEN 'liveFeedback' END AS data__additionalfeedback,
           CASE WHEN l_partkey % 5 = 0 THEN 'ratings' END AS data__screen,
           'q' || CAST(l_linenumber % 8 AS VARCHAR) AS data__questionid, day AS yyyymmdd
    FROM f_rides WHERE l_partkey % 6 = 0 OR l_partkey % 5 = 0""", ("f_rides",)),
    "w_cancels": ("""
    SELECT cap AS c_cap, day AS c_day,
           count(*) FILTER (WHERE o_custkey % 2 <> 1 AND l_linestatus = 'O') AS male_ocara_count_captainlevel,
           count(*) FILTER (WHERE o_custkey % 2 = 1 AND l_linestatus = 'O') AS female_ocara_count_captainlevel,
           count(*) FILTER (WHERE o_custkey % 2 <> 1 AND l_linestatus = 'F') AS male_cc_count_captainlevel,
           count(*) FILTER (WHERE o_custkey % 2 = 1 AND l_linestatus = 'F') AS female_cc_count_captainlevel
    FROM f_rides WHERE l_returnflag = 'N' GROUP BY cap, day""", ("f_rides",)),
    "w1": (f"""
    SELECT oid AS order_id, l_shipdate AS order_date, cap AS captain_id,
           CAST(o_custkey AS VARCHAR) AS customer_id, CAST(o_custkey % 2 AS INTEGER) AS customer_gender,
           r_name AS city_name, {RATING} AS customer_feedback_rating, {STATUS} AS order_status,
           day AS yyyymmdd, 'Link' AS riderinfo__servicenames, 'bike_motorbike' AS service_type,
           'SHIFT_' || CAST(l_orderkey % 5 AS VARCHAR) AS shift_name, r_name AS ride_city,
           '000-' || cap AS mobile,
           c.male_ocara_count_captainlevel, c.female_ocara_count_captainlevel,
           c.male_cc_count_captainlevel, c.female_cc_count_captainlevel,
           CASE WHEN (l_partkey + o_custkey % 2) % 4 = 0
                THEN 1 + (l_orderkey % 7) * (l_linenumber % 2) END AS total_calls_doneby_captain,
           CASE WHEN ({CHAT}) IS NOT NULL THEN 'CHAT' END AS chat_agent_input_type,
           {CHAT} AS chat_agent_response_issue_type,
           CASE WHEN ({TICKET(1)}) IS NOT NULL THEN 'SUPPORT_TICKET' END AS support_ticket_agent_input_type,
           {TICKET(1)} AS support_ticket_agent_response_issue_type,
           CASE WHEN ({REVIEW}) IS NOT NULL THEN 'POST_RIDE_REVIEW' END AS post_ride_review_agent_input_type,
           {REVIEW} AS post_ride_review_agent_response_issue_type,
           CASE WHEN l_partkey % 5 = 0 THEN ({RATE}) END AS rating_screen_feedback,
           CASE WHEN l_partkey % 6 = 0 THEN ({LIVE}) END AS live_feedback_feedback
    FROM f_rides f LEFT JOIN w_cancels c ON f.cap = c.c_cap AND f.day = c.c_day""", ("f_rides", "w_cancels")),
}


def resolve(names, table: dict[str, tuple[str, tuple[str, ...]]]) -> list[str]:
    """Topologically ordered CTE names needed for ``names``."""
    out: list[str] = []

    def visit(n: str) -> None:
        if n in out:
            return
        for d in table[n][1]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def with_ctes(names, table: dict[str, tuple[str, tuple[str, ...]]]) -> str:
    order = resolve(names, table)
    return "WITH " + ",\n".join(f"{n} AS ({table[n][0]}\n)" for n in order)
