"""Word lists and limits that results depend on, kept as they are."""

# --- fixed values: tokens -------------------------------------------------------------------------------------------
STOP_CHARS = "的是了和及或在将把与就还都也着"
GENERIC_TOKENS = ["什么", "这个", "那个", "项目", "系统", "当前", "直接", "相关", "支持", "实现", "方式", "时机", "目标", "关键", "结论", "问题", "情况", "功能", "方案", "策略", "请按", "请从", "请结", "哪些", "需要", "执行", "动作", "日常", "维护"]
GENERIC_CHARS = "这个那个项目支持当前直接相关目标触发时机实现方式关键结论什么请按从与及和是否到底究竟"

# --- fixed values: intents, tried in this order ---------------------------------------------------------------------
INTENTS = {
    "ARCHITECTURE": ["architecture", "design", "adr", "架构", "设计", "方案", "取舍", "为什么要", "优缺点", "对比", "消息队列", "同步调用", "异步", "解耦"],
    "CODE_STRUCTURE": [".java", "class", "method", "controller", "service", "repository", "调用链", "类名", "方法", "接口实现", "源码", "代码"],
    "CONFIGURATION": [".yaml", ".yml", ".properties", "config", "配置", "参数", "阈值", "开关", "timeout", "retry", "endpoint", "url", "key"],
    "TROUBLESHOOTING": ["error", "exception", "failed", "fail", "失败", "异常", "报错", "排查", "为什么不", "无法", "超时"],
}

# --- fixed values: channels, their base weights, and what intents and semantic questions multiply them by ------------
CHANNELS = {"fts": 1.0, "article_chunk_fts": 1.25, "refkey": 1.45, "source": 1.0, "source_chunk_fts": 1.30, "contribution": 1.0, "graph": 1.20, "article_vector": 1.0, "chunk_vector": 1.35}
RRF_K = 60
INTENT_BOOST = {
    "CODE_STRUCTURE": {"graph": 1.35, "source": 1.15, "source_chunk_fts": 1.35, "article_chunk_fts": 1.15},
    "CONFIGURATION": {"refkey": 1.35, "source": 1.15, "source_chunk_fts": 1.35, "article_chunk_fts": 1.15},
    "TROUBLESHOOTING": {"contribution": 1.25, "source_chunk_fts": 1.20, "article_chunk_fts": 1.15, "refkey": 1.10, "graph": 1.10},
    "ARCHITECTURE": {"graph": 1.25, "article_vector": 1.25, "chunk_vector": 1.20, "article_chunk_fts": 1.10},
}
SEMANTIC_BOOST = {"article_vector": 1.10, "chunk_vector": 1.05}

# --- fixed values: reranking ----------------------------------------------------------------------------------------
CONFIG_ENDINGS = [".yaml", ".yml", ".properties", ".json", ".java"]
ARCHITECTURE_PARTS = ["/architecture/", "architecture/", "/adr/", "adr/", "design", "mq"]
IMAGE_ENDINGS = [".png", ".jpg", ".jpeg", ".gif", ".svg", ".bmp", ".webp"]
META_PARTS = ["images", "readme", "benchmark", "guide", "handbook", "manual", "checklist", "清单", "手册", "截图", "方案", "overview", "settings", "developer"]

# --- fixed values: routing of deep research --------------------------------------------------------------------------
COMPARISONS = ["区别", "差异", "对比", "比较", " vs ", " versus "]
DEEP_WORDS = ["为什么", "排查", "调用链", "影响"]
DELIMITERS = ["、", "，", ",", "/", "与", "和", "及", " and ", "&"]

# --- fixed values: ingest -------------------------------------------------------------------------------------------
SKIP_DIRS = [".git", "target", "dist", "node_modules"]
INGEST_CHARS = 65536
NAME_SCORES = [("overview.", 100), ("readme.", 95), ("architecture.", 85), ("domain.", 80), ("design.", 75), ("api.", 70), ("config.", 60)]
BINARY_ENDINGS = [".png", ".jpg", ".jpeg", ".gif", ".pdf", ".zip", ".mp4", ".mov"]

# --- fixed values: questions and evidence that are accepted beside the general rule -----------------------------------
FLOW_QUESTIONS = ["流程", "链路", "步骤", "怎么跑", "怎么走", "运行路径"]
FLOW_SIGNALS = ["主链路", "链路", "流程", "source sync", "compile graph", "query graph", "pending_queries", "contributions", "资料先进入", "再进入编译层", "提交问题", "启动问答链路"]
CAPABILITY_QUESTIONS = ["支持", "接入", "入口", "方式", "能力", "有哪些"]
CAPABILITY_TOPICS = ["开发", "接入", "入口", "方式", "能力", "api", "cli", "mcp", "http", "web", "sdk"]
CAPABILITY_SIGNALS = ["api", "cli", "mcp", "http", "web", "sdk", "入口", "接入"]
LIST_SEPARATORS = ["、", " / ", "·"]
UPKEEP_ANCHORS = ["trans-job", "xxljob", "补偿"]
UPKEEP_ACTIONS = ["维护", "动作", "执行", "任务"]
UPKEEP_TOKENS = ["trans", "xxljob", "job", "bogo", "买一赠一", "补偿"]

# --- fixed values: what a subject's question is stripped of -------------------------------------------------------------
COMPARISON_MARK = "对比"
SUBJECT_PHRASES = ["有什么区别", "区别是什么", "的关键结论是什么"]
SUBJECT_ENDINGS = ["[？?。！!]+$", "是什么$", "吗$"]

# --- fixed values: marks of repaired answers ----------------------------------------------------------------------------
NO_EVIDENCE = "当前证据不足"

# --- fixed values: types of questions, and what lines must hold to answer them ---------------------------------------------
QUESTION_TYPES = {
    "fact": ["配置", "参数", "阈值", "观察窗口", "多少", "几", "数值", "值", "分别"],
    "number": ["多少", "几", "数值", "值", "阈值", "窗口", "分别"],
    "setup": ["需要", "配置", "准备", "顺序"],
    "capability": CAPABILITY_QUESTIONS,
    "listing": ["有哪些", "哪些", "几种", "几个", "列出", "包括", "包含", "分别", "技巧", "形态", "字段", "渠道", "步骤", "主要完成"],
    "status": ["状态", "可用", "是否可用", "是否启用", "就绪", "待配置", "是否正常"],
    "flow": FLOW_QUESTIONS,
    "current": ["现在", "当前"],
}
CURRENT_SIGNS = ["当前", "建议值"]
STATUS_SIGNS = ["当前可用", "已可用", "不可用", "待配置", "未配置", "启用", "禁用", "就绪", "正常", "还没有", "未发现"]
SETUP_SIGNS = ["准备好", "确认", "创建", "schema", "profile", "环境变量", "容器", "启动", "顺序", "步骤", "处理的事情", "只需要", "只有 4 件"]
STEP_SIGNS = ["federation", "saml endpoint", "entity id", "claim", "saml request", "saml response", "证书", "身份验证", "完成用户登录"]
SUMMARY_SENTENCES = "^(?:换句话说|本质上)|更像一个|而不是一个"
KEY_PARTS = [".", "_", "threshold", "window", "timeout", "retry", "psp rt", "观察窗口"]
LINE_WORDS = [
    (["乐观锁", "悲观锁", "redis", "distributed lock", "inventory_lock_version"], 6),
    (["采用", "通过", "使用字段", "默认值", "配置项"], 4),
    (["本条目汇总", "主要记录了", "记录了若干", "回答时需要", "当前资料", "文档规则", "现有资料主要包含", "在当前资料中", "主要聚焦于"], -8),
    (["汇总", "概述", "概要"], -3),
    (["应视为", "而非", "来源未展开", "适用条件", "不能进一步断言", "未提供校准依据"], -8),
]
TEXT_FIELDS = ["summary:", "description:", "content:"]
FIELD_LINES = "^(?:title|referential_keywords|sources|source_paths|article_key|concept_id|file_path|metadata|depends_on|related|confidence|compiled_at|review_status|lifecycle):|^<h[1-4]"
ECHO_SIGNS = "[#*`|\\[\\]（）()“”\"'：:；;，,。！？?\\s-]+"
FOCUS_SEPARATORS = "和|以及|及|、|/|，|,"
FOCUS_FILLERS = ["当前", "现在", "目前", "分别", "多少", "几", "数值", "参数", "配置", "是什么", "是多少", "值"]
FOCUS_SIGNS = "[？?。！!：:（）()“”\"'`]"
