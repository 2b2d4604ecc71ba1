"""Whether a section asks for a diagram, and of which type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that ask for a diagram, patterns that ask for one outright, and the types by what is said, the first that fits.
KEYWORDS = (
    "architecture", "topology", "deployment architecture", "flowchart", "flow diagram", "data flow", "component diagram", "sequence",
    "layered architecture", "network model", "network topology", "resource pool", "resource pools", "physical isolation", "silo", "siloed",
    "microservice", "cluster deployment", "high availability", "disaster recovery", "end-to-end", "pipeline", "phased",
    "milestone timeline", "toolchain", "multi-tenant",
    "架构", "系统架构", "总体架构", "技术架构", "部署架构", "应用架构", "数据架构", "拓扑", "网络拓扑", "部署拓扑", "资源池", "物理隔离", "资源孤岛",
    "烟囱式", "信创", "流程", "业务流程", "处理流程", "数据流", "时序", "调用链路", "组件", "模块关系", "集群", "高可用", "容灾", "微服务", "多租户",
    "管道", "流水线", "工具链", "路线图", "阶段计划",
)
EXPLICIT = r"include\s+(an?\s+)?(architecture\s+)?diagram|include\s+(a\s+)?flowchart|diagram\s+required|需要.*图|包含.*图|画图|架构图|流程图|拓扑图|时序图|组件图|数据流图"
TYPES = (
    ("sequence", "sequence|时序|调用链路"),
    ("data-flow", r"data\s+flow|数据流"),
    ("flowchart", r"flowchart|flow\s+diagram|流程"),
    ("deployment", r"topology|deployment|resource\s+pools?|physical\s+isolation|siloed?|拓扑|部署|资源池|物理隔离|资源孤岛|烟囱式|信创"),
    ("timeline", "timeline|roadmap|milestone|路线图|阶段"),
)


def section_text(*parts: Column) -> Column:
    """What is looked at: the parts that are not empty, lower-cased."""
    return F.lower(F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts]))


def needs_diagram(text: Column) -> Column:
    hit = text.rlike(f"(?i){EXPLICIT}")
    for k in KEYWORDS:
        hit = hit | F.contains(text, F.lit(k))
    return F.coalesce(hit, F.lit(False))


def diagram_type(text: Column) -> Column:
    out = F.lit("architecture")
    for name, pattern in reversed(TYPES):
        out = F.when(text.rlike(f"(?i){pattern}"), name).otherwise(out)
    return out
