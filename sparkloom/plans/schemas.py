"""Declared schemas, the taxonomy, and default rule tables. Rules are data: callers may pass their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BOUND = "array<struct<name:string,custom:boolean>>"
MANIFEST = (
    f"name string, id string, description string, author string, version string, system_prompt string, params map<string,string>, skills {BOUND}, mcps {BOUND}, "
    "kb_refs array<string>, examples array<struct<turn:int,role:string,text:string>>, _corrupt_record string"
)
FINDING = ["agent_key", "rule", "severity", "evidence"]
SEVERITIES = {"fail": 2, "unknown": 1, "warn": 0}
GENERIC, INDUSTRY, OTHER = "通用智能体", "行业智能体", "其他"
#: The categories of either root.
CATEGORIES = {
    GENERIC: ["研究与分析", "内容创作", "开发与编程", "商业与营销", "自动化与工作流", "教育与培训", "沟通与支持", "数据处理", "创意与设计", OTHER],
    INDUSTRY: ["医疗", "金融", "政务"],
}
REQUIRED = ["name", "id", "description", "author", "system_prompt"]
PROMPT_RULES = [
    ("role", r"(?i)\byou are\b|\byour role\b|你是|角色"),
    ("task", r"(?i)\btask\b|\bgoal\b|任务|目标"),
    ("output_format", r"(?i)\boutput\b|\bformat\b|\bjson\b|输出|格式"),
    ("example", r"(?i)\bexample\b|\binput:|示例|例如"),
    ("edge_cases", r"(?i)\bif (the|no|there)\b|\bunless\b|\botherwise\b|如果|边界|异常"),
]
SENSITIVE_RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("ipv4", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"),
    ("phone", r"\+[0-9]{1,3} ?\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}"),
    ("card", r"\b[0-9]{16}\b"),
    ("token", r"(?:token|password|secret) ?= ?\"?[A-Za-z0-9]{8,}"),
]
CODE_RULES = [
    ("dynamic_eval", r"\b(?:eval|exec|compile)\s*\("),
    ("shell", r"\b(?:os\.system|subprocess\.|popen)"),
    ("network", r"\b(?:requests\.|urllib\.|socket\.|https?://)"),
    ("environment", r"\b(?:os\.environ|getenv)"),
    ("credential", r"\b(?:token|password|secret) ?="),
]
LICENCE_RULES = [
    ("apache-2.0", r"Apache License,? Version 2\.0", True),
    ("mit", r"MIT License", True),
    ("gpl-3.0", r"GNU General Public License,? version 3", False),
    ("cc-by-nc-4.0", r"CC BY-NC 4\.0", False),
]
#: What every match of a rule holds, one of each list. Lines without it aren't matched with the pattern.
NEEDED = {
    "email": ["@"], "phone": ["+"], "token": ["="], "ipv4": [*"0123456789"], "card": [*"0123456789"],
    "dynamic_eval": ["("], "shell": ["os.system", "subprocess.", "popen"], "network": ["requests.", "urllib.", "socket.", "://"], "environment": ["os.environ", "getenv"], "credential": ["="],
    "apache-2.0": ["Apache License"], "mit": ["MIT License"], "gpl-3.0": ["GNU General Public License"], "cc-by-nc-4.0": ["CC BY-NC 4.0"],
}


def taxonomy(spark: SparkSession) -> DataFrame:
    """root, category: one row a category."""
    return spark.createDataFrame([(r, c) for r, cs in CATEGORIES.items() for c in cs], "root string, category string")
