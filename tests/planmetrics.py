"""Numbers from the physical plan of an executed DataFrame."""


def nodes(df):
    """Every node of the final plan, query stages opened."""
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            yield name, node
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]


def exchanged_rows(df) -> list[int]:
    """Rows written by each shuffle of an executed ``df``."""
    out = []
    for name, node in nodes(df):
        if name == "ShuffleExchangeExec":
            out.append(node.metrics().get("shuffleRecordsWritten").get().value())
    return out


def scans(df, part: str) -> int:
    """File scans of the plan whose location has ``part`` in it."""
    return sum(name == "FileSourceScanExec" and part in node.simpleString(2000) for name, node in nodes(df))
