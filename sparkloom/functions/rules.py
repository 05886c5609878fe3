"""Fixed values of the text rules: patterns, word lists and scores that results depend on."""

GREETING_PREFIX = r"(?i)^\s*(?:你好|您好|hi|hello|哈喽|在吗|在不在|有人吗)[啊呀呢嘛么]*(?:[\s,，:：;；!！。.?？]+)"
POLITE_PREFIX = (
    r"(?i)^\s*(?:请问一下|请问|我想问一下|想问一下|咨询一下|问一下|"
    r"麻烦(?:你|您)?(?:帮我)?(?:看下|看一下|查下|查一下|确认下|确认一下|处理下|处理一下)|"
    r"帮我(?:看下|看一下|查下|查一下|确认下|确认一下)|帮忙(?:看下|看一下|查下|查一下|确认下|确认一下))[\s,，:：;；!！。.?？]*"
)
LEADING = r"^[ \t\r\n,，:：;；!！。.?？]+"
GREETING = r"(?i)^(你好|您好|hi|hello|哈喽|在吗|在不在|有人吗)[啊呀呢嘛么\s,，!！。.?？]*$"
IDENTITY = r"(?i)^(你是谁|您是谁|你叫什么|你的名字|who are you)[\s,，!！。.?？]*$"
OFF_TOPIC = r"(彩票|赌博|股票内幕|色情|违法|攻击|破解|黑客入侵)"
HUMAN_SERVICE = r"(人工客服|转人工|客服|客服电话|电话|联系方式|联系顾问|联系电话)"
FOLLOW_UP = r"^(那|这个|那个|它|他们|她们|这些|上面|刚才|继续|还有|费用呢|审批呢|权限呢|发票呢|告警呢|步骤呢)"
FAQ_HINTS = r"(费用|价格|安装|环境|失败|报错|地址|时间|退费|优惠|发票|账号|登录|权限|审批|合同|隐私|账单|支付|开票|工单|售后)"
KNOWLEDGE_HINTS = r"(知识库|文档|手册|流程|制度|规范|说明|配置|接口|功能|排查|故障|步骤|sop|告警|巡检|设备|合规|条款|入职|审批|合同|隐私|webhook|回调|发票|账单)"
FAQ_SHAPE = r"(怎么办|如何处理|怎么处理|需要什么|需要哪些|需要准备哪些|有哪些|为什么|什么时候|由谁|能不能|会不会)"
DIRECT_SHAPE = r"(资料呢|材料呢|是什么|如何回收|怎么排查|怎么处理|能不能|可以吗|要看什么)"
PRICING = (
    r"(费用|价格|学费|报价|优惠|折扣|退费|退款|发票|账单|支付|开票|续费|合同金额|收费|付款|"
    r"赔付|赔款|金额|回款|预算|采购|报销|信用证|保证金|付款条件|收款账户|打款|结算|税费)"
)
COMPLIANCE = (
    r"(合规|隐私|个人信息|客户数据|外部平台|合同|条款|审计|风险|违规|保密|权限审批|数据出境|授权|责任|"
    r"制裁|名单|出口管制|强制性|规范|标准|图纸冲突|除外|免责|不赔|拒赔|HS\s*编码|海关|报关|申报|"
    r"归类|最终用途|最终用户|尽调|受限空间|作业审批|安全确认|安全技术交底|检验批|隐蔽工程|验收|既往症|如实告知|保单复效)"
)
TROUBLESHOOTING = r"(故障|报错|失败|无法|异常|告警|报警|排查|维修|巡检|安装|配置|连接不上|超时|错误码)"
SUMMARY = r"(总结|概括|归纳|整理|对比|区别|有哪些|都包括|主要内容|学习内容|大纲)"
TABLE_QUERY = (
    r"(表格|清单|台账|明细|字段|列名|行号|sheet|工作表|导出|列表|矩阵|评分表|检查表|对账|"
    r"材料清单|验收项|付款节点|状态|责任人|金额|数量|单价|收款账户|银行卡|发票号码|箱单|装箱单)"
)
INTENT_SCORES = {"strong_faq": 0.82, "knowledge": 0.84, "source_question_shape": 0.85, "direct_faq_shape": 0.86}
NUMERIC_FACT = r"\d+(?:\.\d+)?\s*(?:元|块|小时|天|周|个月|月|年|%|折|次|人|条|分钟)?"
VERSION_NUMBER = r"(?i)v?20\d{2}\.\d{1,2}"
NEGATIVE = r"(不支持|不能|不可以|不可|不应|不得|无需|不需要|禁止|无法|不会|未开放|不允许|不代表|不一定|资料不足|未经|不得作为)"
POSITIVE = r"(支持|可以|可用|需要|允许|开放|能够|必须|会|建议|应当|应|负责)"
STOP_WORDS = ("什么", "怎么", "如何", "是否", "可以", "需要", "相关", "业务", "问题", "进行", "支持", "通常", "应该", "说明")
OCR_MARKERS = ("复核状态：已复核", "人工复核：通过", "review_status: approved", "review_status: reviewed", "reviewed: true")
OCR_CONFIDENCE = r"OCR 平均置信度[：:]\s*([0-9.]+)"
OCR_SOURCE = r"原始文件[：:]\s*(.+)"
OCR_CARRIER = r"(?i)(扫描件|扫描版|图片PDF|图片 PDF)"
OCR_NOISE = r"(?i)(OCR|断行|错字|O 和 0|噪声)"
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff")
CONTAINER_SUFFIXES = (".pdf", ".docx", ".pptx", ".html")
TABLE_SUFFIXES = (".csv", ".xlsx", ".xls")
SEARCH_MARKERS = ("怎么办", "怎么治疗", "怎么调理", "怎么治", "如何治疗", "如何应对", "需要注意", "怎么", "如何", "有什么", "有哪些", "是什么", "应该", "可以")
SYNONYMS = {
    "头疼": ("头痛", "偏头痛"), "腰部": ("腰",), "肚疼": ("腹痛", "肚子痛"), "胃疼": ("胃痛", "腹痛"), "感冒": ("流行性感冒",), "发烧": ("发热",),
    "拉肚子": ("腹泻",), "睡不着": ("失眠",), "口腔溃疡": ("口疮",), "皮肤痒": ("瘙痒",), "流鼻涕": ("鼻塞", "鼻炎"),
}
RELATION_WORDS = {
    "敌对": ("敌对", "冲突", "对抗", "打压", "竞争"), "合作": ("合作", "联手", "合伙", "协作"), "交易": ("交易", "购买", "售卖", "采购", "出售"), "成员": ("成员", "属于", "归属"),
    "好友": ("好友", "朋友", "伙伴", "亲密"), "父子": ("父亲", "儿子", "父子", "父女", "母亲", "母女"), "师徒": ("师傅", "老师", "教导", "传授", "指导", "徒弟", "弟子"), "领导": ("主管", "负责", "管理", "领导"),
}
RELATION_IGNORED = ("帮助", "进行", "获得", "需要", "一个", "一种", "一些", "这个")
ENTITY_TYPES = ("组织", "人物", "地点", "事件", "概念", "项目", "产品", "文档")
DIRTY = {"expired_policy": r"(?i)过期|V20\d{2}|不得入库|旧版|已废止", "policy_conflict": r"冲突|不一致|旧口径|当前口径", "ocr_review_required": r"(?i)OCR|扫描|错字|识别|O 和 0|断行|噪声", "table_split_required": r"表格|导出|,.*,"}
ERRORS = (
    ("account", r"arrearage|overdue-payment|access denied|unauthorized|authentication|api key|invalid_api_key|invalid api key|401|403"),
    ("timeout", r"timeout|timed out|time out"), ("connection", r"connection|connecterror|connection refused"),
)
VARIANT_RULES = (
    # (any of, all of, ignore case, replacements)
    (("安装", "失败", "报错"), (), False, (("失败", "报错"), ("报错", "失败"))),
    (("流程",), (), False, (("流程", "SOP"), ("流程", "处理步骤"), ("流程", "办理流程"))),
    (("发票",), (), False, (("发票", "开票"), ("发票", "账单"))),
    (("开票",), (), False, (("开票", "发票"),)),
    (("告警",), (), False, (("告警", "报警"), ("告警", "异常"))),
    (("webhook",), (), True, (("webhook", "回调"), ("webhook", "Webhook 回调"))),
    (("资料",), (), False, (("资料", "材料"), ("资料", "记录"))),
    (("材料",), (), False, (("材料", "资料"),)),
    ((), ("流程", "怎么走"), False, (("怎么走", "有哪些步骤"), ("流程", "办理流程"))),
    (("怎么排查",), (), False, (("怎么排查", "如何处理"), ("怎么排查", "处理步骤"))),
    (("能不能",), (), False, (("能不能", "是否可以"),)),
    (("可以吗",), (), False, (("可以吗", "是否可以"),)),
)
SHORT_STRUCTURED = ("怎么走", "资料", "材料", "怎么排查", "怎么处理", "需要哪些", "能不能", "可以吗", "是什么", "要看什么")
FAQ_FAST_HINTS = ("怎么办", "如何", "怎么", "怎么处理", "需要什么", "需要哪些", "需要谁", "有哪些", "为什么", "什么时候", "能不能", "可以吗", "会不会", "是否", "吗", "什么", "谁")
