"""Which SQL may run over a catalog: one query over named tables, decided on the parsed plan and not on its text.

The parser's tree is walked node by node and expression by expression, with the queries inside expressions. Everything must
be known: kinds of nodes and expressions, functions, and relations, which are a table of the catalog or a query that a WITH
around them has named. Names follow nesting: a named query is known to the later ones of its WITH and to that WITH's body,
and nowhere else. What is not known is refused, so a literal can't pass for a name, and how a plan is printed is no matter.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import ParseException
from pyspark.sql import SparkSession

#: What a query may call.
FUNCTIONS = frozenset(
    """abs any_value array array_agg avg between bool_and bool_or cast ceil coalesce collect_list collect_set concat concat_ws contains corr count count_if cume_dist date date_add date_diff date_format date_sub
    date_trunc datediff day dayofmonth dayofweek dense_rank endswith exp extract first first_value floor format_number greatest grouping grouping_id if ifnull instr isnotnull isnull lag last last_value lead least left length ln
    log lower lpad ltrim make_date max max_by mean median min min_by mod month nth_value ntile nullif nvl percent_rank percentile percentile_approx power quarter rank regexp_extract regexp_like
    regexp_replace replace reverse right round row_number rpad rtrim sequence sha2 sign size split sqrt startswith std stddev stddev_pop stddev_samp struct substr substring sum to_date trim trunc
    try_divide upper var_pop var_samp variance weekday weekofyear when year""".split()
)
#: Nodes of a query; a relation, a WITH and its parts are looked at closer.
NODES = frozenset(
    """Aggregate Distinct Except Filter GlobalLimit Intersect Join LocalLimit LocalRelation Offset OneRowRelation Project Sort SubqueryAlias Union UnresolvedHaving UnresolvedInlineTable UnresolvedRelation
    UnresolvedSubqueryColumnAliases UnresolvedWith WithWindowDefinition""".split()
)
EXPRESSIONS = frozenset(
    """Add Alias And Between BitwiseAnd BitwiseOr BitwiseXor CaseWhen Cast Concat Cube CurrentRow Divide EqualNullSafe EqualTo Exists GreaterThan GreaterThanOrEqual GroupingSets ILike In InSubquery IntegralDivide IsNotNull IsNull LessThan
    LessThanOrEqual Like LikeAll LikeAny ListQuery Literal Multiply NamedParameter Not NotLikeAll NotLikeAny Or PosParameter RLike Remainder Rollup ScalarSubquery SortOrder SpecifiedWindowFrame
    StringTrim StringTrimLeft StringTrimRight Subtract UnaryMinus UnaryPositive UnboundedFollowing UnboundedPreceding UnresolvedAlias UnresolvedAttribute UnresolvedExtractValue UnresolvedFunction UnresolvedOrdinal UnresolvedStar
    UnresolvedWindowExpression UnspecifiedFrame WindowExpression WindowSpecDefinition""".split()
)
#: Names without parentheses that are functions of the session where no column has them.
SESSION_WORDS = frozenset("current_catalog current_database current_date current_schema current_time current_timestamp current_user localtimestamp session_user user".split())


def check(session: SparkSession, sql: str, tables: Iterable[str]) -> None:
    """PermissionError unless ``sql`` is exactly one query over ``tables``."""
    try:
        plan = session._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as e:
        raise PermissionError("not one readable statement") from e
    _Walk(session, tables).query(plan)


class _Walk:
    def __init__(self, session: SparkSession, tables: Iterable[str]):
        self._java = session._jvm.scala.jdk.javaapi.CollectionConverters.asJava
        self._plan = session._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.expressions.PlanExpression")
        self._tables = frozenset(t.lower() for t in tables)

    def query(self, plan) -> None:
        # nodes and expressions that are left, each with the names known where it stands
        left = [(plan, True, self._tables)]
        while left:
            one, is_node, known = left.pop()
            left += self._node(one, known) if is_node else self._expression(one, known)

    def _kind(self, one) -> str:
        return one.getClass().getSimpleName().rstrip("$")

    def _node(self, node, known: frozenset) -> list:
        kind = self._kind(node)
        if kind not in NODES:
            raise PermissionError(f"only a SELECT is allowed, not {kind}")
        if kind == "UnresolvedRelation":
            name = list(self._java(node.multipartIdentifier()))
            if len(name) != 1 or name[0].lower() not in known:
                raise PermissionError(f"not a table of the catalog: {'.'.join(name)}")
        if kind == "LocalRelation":  # rows of VALUES, computed already
            return []
        more = []
        if kind == "UnresolvedWith":
            inside = known
            for named in self._java(node.cteRelations()):
                own = inside | {named._1().lower()} if node.allowRecursion() else inside
                more.append((named._2(), True, own))
                inside = inside | {named._1().lower()}
            return [*more, (node.child(), True, inside)]
        if kind == "WithWindowDefinition":
            more += [(x, False, known) for x in self._java(node.windowDefinitions()).values()]
        more += [(x, False, known) for x in self._java(node.expressions())]
        return more + [(x, True, known) for x in self._java(node.children())]

    def _expression(self, one, known: frozenset) -> list:
        kind = self._kind(one)
        if kind not in EXPRESSIONS:
            raise PermissionError(f"an expression that is not allowed: {kind}")
        if kind == "UnresolvedFunction":
            name = list(self._java(one.nameParts()))
            if len(name) != 1 or name[0].lower() not in FUNCTIONS:
                raise PermissionError(f"a function that is not allowed: {'.'.join(name)}")
        if kind == "UnresolvedAttribute":
            name = list(self._java(one.nameParts()))
            if len(name) == 1 and name[0].lower() in SESSION_WORDS:
                raise PermissionError(f"a function that is not allowed: {name[0]}")
        inner = [(one.plan(), True, known)] if self._plan.isInstance(one) else []
        return inner + [(x, False, known) for x in self._java(one.children())]
