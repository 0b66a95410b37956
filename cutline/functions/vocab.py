"""Fixed values of the admission domain.

Every list here is a fixed value: results depend on the exact words, so they are
stated as plain text. Operators take them as arguments with these defaults.
"""

# Subjects in evaluation order, with the label used in messages.
SUBJECT_KEYS = ["chinese", "english", "math_a", "math_b", "social", "science"]
SUBJECT_LABELS = {
    "chinese": "国文",
    "english": "英文",
    "math_a": "数学A",
    "math_b": "数学B",
    "social": "社会",
    "science": "自然",
}

# Ordered domains.
STANDARD_RANK = {"底标": 1, "后标": 2, "均标": 3, "前标": 4, "顶标": 5}
TIER_RANK = {"非双一流": 1, "双一流": 2, "211": 3, "985": 4}
CONFIDENCE_RANK = {"low": 1, "medium": 2, "high": 3}
STATUS_RANK = {"success": 3, "not_found": 2, "failed": 1}
LISTENING_RANK = {"F": 1, "C": 2, "B": 3, "A": 4}
BUCKET_RANK = {"oppty": 0, "star_good": 1, "star_edge": 2, "star_hard": 3, "incomplete": 4}
BUCKETS = ["oppty", "star_good", "star_edge", "star_hard", "incomplete"]

# Standard words, traditional form to simplified form.
STANDARD_FORMS = {
    "頂標": "顶标",
    "前標": "前标",
    "均標": "均标",
    "後標": "后标",
    "底標": "底标",
    "顶标": "顶标",
    "前标": "前标",
    "均标": "均标",
    "后标": "后标",
    "底标": "底标",
}

# Order in which a text is searched for a standard.
STANDARD_SEARCH = [
    ("顶标", ["顶标", "頂標"]),
    ("前标", ["前标", "前標"]),
    ("均标", ["均标", "均標"]),
    ("后标", ["后标", "後標"]),
    ("底标", ["底标", "底標"]),
]

# Subject names on programme pages.
SUBJECT_NAMES = {
    "国文": "chinese",
    "國文": "chinese",
    "英文": "english",
    "英語": "english",
    "英语": "english",
    "數學A": "math_a",
    "数学A": "math_a",
    "數學B": "math_b",
    "数学B": "math_b",
    "社會": "social",
    "社会": "social",
    "自然": "science",
    "英聽": "listen",
    "英听": "listen",
}

# Subject words in free text, first match order.
TEXT_SUBJECTS = {
    "语文": "chinese",
    "国文": "chinese",
    "英文": "english",
    "英语": "english",
    "数学A": "math_a",
    "數學A": "math_a",
    "数学B": "math_b",
    "數學B": "math_b",
    "社会": "social",
    "社會": "social",
    "自然": "science",
}

# Percentile names in tie-break items.
PERCENT_SUBJECTS = {
    "國語文": "chinese",
    "語文": "chinese",
    "英語文": "english",
    "數學": "math",
    "社會": "social",
    "自然": "science",
    "歷史": "history",
    "地理": "geo",
    "公民": "civics",
}

# Words that mean "any one of".
CHOICE_WORDS = [
    "任一",
    "其一",
    "择一",
    "擇一",
    "之一",
    "任意",
    "其中一",
    "任何一",
]
CHOICE_WORDS_LONG = [
    "任一科", "任一門", "任一门", "任一項", "任一项", "任一", "其一", "择一", "擇一", "之一", "任意",
    "多者其一", "其中一", "任何一科", "任何一門", "任何一门", "任何一項", "任何一项", "任何一",
]
FOUR_SUBJECT_WORDS = ["四科", "四门", "四項", "四项", "四科目"]

# Hosts whose pages are weak evidence (a hint may be any part of the host).
LOW_QUALITY_HOSTS = [
    "zhihu.com", "zhidao.baidu.com", "jingyan.baidu.com", "baike.baidu.com", "wikipedia.org",
    "reddit.com", "microsoft.com", "google.com", "techcommunity.microsoft.com", "39.net",
    "commentcamarche.net", "policyx.com", "kabu-sokuhou.com", "lahoratime.com", "ncert.nic.in",
    "tinhte.vn",
]

# Second-level suffixes that count as one label.
SECOND_LEVEL_SUFFIXES = ["com.cn", "edu.cn", "gov.cn", "org.cn", "net.cn", "ac.cn"]

# Host and path words of admission offices.
ADMISSION_HOST_WORDS = ["zsb", "admission", "zhaosheng", "bkzs", "recruit"]
ADMISSION_URL_WORDS = ["zsb", "admission", "zs.", "bkzs", "recruit", "zhaosheng", "gat"]

# Evidence words.
REVIEW_SIGNALS = ["报名要求", "招生计划", "学院", "专业", "学测", "台湾", "简章", "前标", "均标"]
REVIEW_NOTE = "可能存在图片/附件中的科目要求，建议人工复核原文与附件。"
RULE_NOTE = "（由规则兜底从正文识别科目要求）"
SHORT_TEXT_SIGNALS = [
    "2026", "台湾", "台灣", "学测", "學測", "学科能力测试", "学科能力测验", "學科能力測驗",
    "學科能力測試", "简章", "簡章", "前标", "均标", "顶标",
]
SEARCH_HIT_WORDS = [
    "2026", "台湾", "台灣", "学测", "學測", "学科能力测试", "学科能力测验", "學科能力測驗",
    "學科能力測試", "招生", "简章", "簡章", "港澳台",
]
SHORT_FAILURE_PATTERN = "内容过短|为空|未找到有效内容|无法获取招生简章内容"
SHORT_FAILURE_NOTE = "内容过短或未命中2026台湾学测简章正文"

# Link and image rules.
DOCUMENT_SUFFIXES = [".pdf", ".doc", ".docx", ".xls", ".xlsx"]
LINK_SUFFIXES = [".pdf", ".doc", ".docx", ".xls", ".xlsx", ".png", ".jpg", ".jpeg"]
DOWNLOAD_WORDS = ["download", "attachment", "downattach", "fileid="]
LINK_WORDS = ["简章", "招生", "台湾", "学测", "港澳台"]
IMAGE_SUFFIXES = [".png", ".jpg", ".jpeg", ".webp"]
IMAGE_STOP_WORDS = ["logo", "banner", "footer", "icon", "menu", "close", "wx", "qrcode", "zscode"]
# Fixed values: (field, words, points) of the candidate-link score; field is combo, href or text.
LINK_SCORE = [
    ("combo", ["2026", "26年"], 4),
    ("combo", ["台湾", "台灣", "港澳台"], 4),
    ("combo", ["学测", "學測"], 4),
    ("combo", ["学科能力测试", "学科能力测验", "學科能力測驗", "學科能力測試"], 3),
    ("combo", ["简章", "簡章", "招生", "招生简章"], 3),
    ("attachment", LINK_SUFFIXES + DOWNLOAD_WORDS, 2),
    ("text", ["附件", "下载", "點擊下載", "点击下载"], 2),
    ("href", ["javascript:", "mailto:", "weibo.com", "zhihu.com"], -5),
]

# Campus and city endings dropped from institution names.
NAME_SUFFIXES = ["珠海校区", "北京", "武汉", "华东", "保定", "徐州"]

# Track words.
TRACK_MIXED = ["文理兼", "兼收", "兼招", "文理兼收", "文理兼招", "普通类", "普通類"]
TRACK_ARTS = [
    "文史", "文科", "经管", "經管", "管理", "经济", "經濟", "外语", "外語", "法学", "文学", "文學",
    "历史", "歷史", "哲学", "哲學", "教育", "新闻", "新聞", "传播", "傳播", "社会", "社會", "汉语言",
    "漢語", "英语", "英語", "日语", "日語", "会计", "會計", "金融",
]
TRACK_SCIENCE = [
    "理工", "理科", "工科", "计算机", "計算機", "软件", "數據", "数据", "人工智能", "信息", "電子",
    "电子", "通信", "自動化", "自动化", "机械", "材料", "土木", "电气", "電氣", "数学", "數學", "物理",
    "化学", "生物", "医学", "药学", "工程", "技術", "技术",
]

# Flexibility signals (pattern, label).
FLEX_SIGNALS = [
    ("资料审核|材料审核|资料审查|材料审查|资格审核|资格審核", "资料审核"),
    ("面试|面試|面談|远程面试|線上面試|线上面试", "面试"),
    ("择优|擇優|综合素质|綜合素質|综合评定|綜合評定", "择优"),
    ("作品集|portfolio|项目|專案|竞赛|競賽", "作品/项目"),
]

# Two-character names that are majors although they end in neither 学 nor 语.
TWO_CHAR_MAJORS = [
    "音乐", "舞蹈", "绘画", "摄影", "动画", "雕塑", "书法", "表演", "戏剧", "美术", "体育", "翻译",
    "播音", "编导", "导演",
]
UNIT_WORDS = ["学院", "學院", "学部", "學部", "院系", "院（系）", "院(系)"]

# Words that rule a name out as a major.
MAJOR_STOP_WORDS = [
    "首页", "返回", "当前位置", "友情链接", "版权所有", "技术支持", "点击", "查看", "更多", "上页",
    "下页", "尾页", "通知", "公告", "快讯", "新闻", "政策", "下载", "附件", "简章", "簡章", "指南",
    "指引", "须知", "須知", "规定", "規定", "办法", "辦法", "流程", "时间", "日期", "费用", "收费",
    "学费", "住宿", "地址", "电话", "传真", "邮箱", "网址", "邮编", "工作日", "入校", "入学", "入學",
    "招生", "招收", "报考", "報考", "填报", "网报", "網報", "保送", "教务", "教務", "外事", "參考",
    "参考", "掌握", "具备", "具備", "具有", "要求", "请", "請", "报名", "報名", "申请", "申請",
    "材料", "上传", "上傳", "提交", "填写", "填報", "登录", "登錄", "审核", "審核", "初审", "复核",
    "更正", "补充", "录取", "錄取", "确认", "確認", "公示", "名单", "名單", "成绩", "成績", "学测",
    "學測", "面试", "面試", "体检", "體檢", "身份证", "身份證", "居住证", "居住證", "通行证", "通行證",
    "照片", "影印", "复印", "扫描", "原件", "复印件", "电子版", "学校", "大学", "大學", "中学", "中學",
    "小学", "小學", "高中", "学院", "學院", "院系", "学部", "學部", "校区", "校區", "招生网", "招生網",
    "所有专业", "所有專業", "不编制", "不編制", "分省", "须达", "須達", "不得", "不得参加", "严禁",
    "嚴禁", "未经允许", "未經允許", "版权", "版權", "是中国", "是中國", "保障系统", "保障系統",
]
SENTENCE_MARKS = ["。", "！", "!", "？", "?", "；", ";", "：", ":"]
SUBJECT_BASES = [
    "国文", "國文", "语文", "語文", "英文", "数学", "數學", "数学A", "數學A", "数学B", "數學B",
    "社会", "社會", "自然",
]
MAJOR_SUFFIXES = [
    "学", "工程", "技术", "管理", "经济", "医学", "药学", "制药", "製藥", "科学", "教育", "艺术",
    "设计", "商务", "营销", "工作", "关系", "安全", "系统", "工艺", "仪器", "运输", "造价", "评估",
    "保险", "审计", "会计", "金融", "统计", "建筑", "测绘", "地质", "海洋", "农学", "林学", "水利",
    "水产", "贸易", "园林", "规划", "器件", "理论", "表演", "导演", "编导", "播音", "摄影", "动画",
    "戏剧", "影视", "服装",
]
MAJOR_KEYWORDS = [
    "工程", "管理", "经济", "医学", "药", "护理", "口腔", "临床", "计算机", "软件", "数据", "网络",
    "信息", "智能", "人工智能", "电子", "电气", "通信", "自动化", "机械", "材料", "环境", "能源",
    "土木", "建筑", "金融", "会计", "统计", "法律", "新闻", "传播", "翻译", "艺术", "设计", "音乐",
    "舞蹈", "绘画", "摄影", "动画", "戏剧", "影视", "表演", "导演", "编导", "播音", "体育",
]
APPLIED_WORDS = ["管理", "数据", "信息", "技术", "工程", "智能", "医学"]
DISPLAY_STOP_PATTERN = "学院|院系|学部|系|计划|人数|合计|小计|学制|年制|学费|备注|联系方式|地址|电话|网址|邮箱"

# Line words of the major-list extraction.
LIST_HINTS = [
    "招生专业", "招生專業", "招生专业及计划", "招生专业及招生计划", "招生专业（类）", "招生专业(类)",
    "招生專業（類）", "招生專業(類)", "招生专业名称", "招生專業名稱", "专业名称", "專業名稱", "专业目录",
    "专业及计划",
]
LIST_STOPS = [
    "申请方式", "申請方式", "申请材料", "申請材料", "报名方式", "報名方式", "网上报名", "網上報名",
    "录取", "錄取", "奖学金", "獎學金", "学费", "學費", "联系方式", "聯繫方式", "注意事项", "注意事項",
]
TABLE_HEADERS = ["所属院系", "所属院（系）", "招生专业", "学制", "计划", "人数", "备注"]
FRAGMENT_STOPS = ["学院", "院系", "学部", "系", "专业", "计划", "人数", "学制", "年制", "合计", "小计"]
TOKEN_SEPARATORS = ["，", ",", "/", "\\", "；", ";", "、", "|", "｜"]
