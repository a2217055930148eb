"""Entity types and fixed values of the detection rules."""

PHONE, ID_CARD, BANK_CARD, PASSPORT, EMAIL, NAME, ADDRESS = (
    "CN_PHONE_NUMBER", "CN_ID_CARD", "CN_BANK_CARD", "CN_PASSPORT", "CN_EMAIL", "CN_NAME", "CN_ADDRESS",
)
ENTITIES = (PHONE, ID_CARD, BANK_CARD, PASSPORT, EMAIL, ADDRESS, NAME)

#: Patterns and base scores. Lookarounds keep a match from starting or ending inside a run of letters and digits.
PHONE_PATTERNS = ((r"1[3-9]\d{9}", 0.85), (r"(?:\+86|0086)1[3-9]\d{9}", 0.90), (r"(?:\+86|0086)?1[3-9]\d[\s\-]?\d{4}[\s\-]?\d{4}", 0.75))
ID_CARD_PATTERN, ID_CARD_SCORE = r"(?<![a-zA-Z\d])[1-9](?:\s*\d){17}(?![a-zA-Z\d])", 0.95
ID_CARD_X_PATTERN = r"(?<![a-zA-Z\d])[1-9](?:\s*\d){16}\s*[\dXx](?![a-zA-Z\d])"
ID_CARD_LONG_PATTERN, ID_CARD_LONG_SCORE = r"(?<![a-zA-Z\d])[1-9](?:\s*\d){18}(?![a-zA-Z\d])", 0.90
BANK_CARD_PATTERN, BANK_CARD_SCORES = r"(?<![a-zA-Z\d])\d(?:\s*\d){15,18}(?![a-zA-Z\d])", (0.95, 0.7)
PASSPORT_PATTERNS = ((r"[EG][A-Z]\d{8}", 0.90), (r"[A-Z]{1,2}\d{6,10}", 0.65), (r"[CH]\d{8,10}", 0.80))
EMAIL_PATTERN, EMAIL_SCORES = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", (0.95, 0.85)
TOKEN_PATTERN = r"[一-龥]+|[a-zA-Z]+|[0-9]+|[^\s]"

#: Fixed values of the identity card number: province codes, weights and check characters (GB 11643).
PROVINCES = (11, 12, 13, 14, 15, 21, 22, 23, 31, 32, 33, 34, 35, 36, 37, 41, 42, 43, 44, 45, 46, 50, 51, 52, 53, 54, 61, 62, 63, 64, 65, 71, 81, 82)
CHECK_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
CHECK_CHARACTERS = "10X98765432"
#: Fixed order in which one digit of a 19-digit number is left out to repair it.
REPAIR_ORDER = (6, 7, 8, 0, 1, 2, 3, 4, 5, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18)

#: First six digits of known bank cards.
BANK_BINS = (
    "622202", "622203", "622208", "621225", "621226", "622848", "622849", "622845", "622846", "621660", "621661", "621663", "621665", "621700", "436742", "436745", "622280",
    "622260", "622261", "622262", "622580", "622588", "621286", "621483", "622518", "622520", "622521", "622522", "622615", "622617", "622618", "622622", "622909", "622910",
    "622911", "622912", "622155", "622156", "622157", "622158", "622660", "622661", "622662", "622663", "622630", "622631", "622632", "622568", "622569", "622570", "622690",
    "622691", "622692", "622188", "622199", "622810",
)
#: Common mail domains.
MAIL_DOMAINS = ("qq.com", "163.com", "126.com", "sina.com", "sohu.com", "aliyun.com", "foxmail.com", "outlook.com", "hotmail.com", "gmail.com", "yahoo.com", "icloud.com", "live.com", "yeah.net", "139.com")

#: Context words of each type.
CONTEXT_WORDS = {
    PHONE: ("手机", "电话", "联系方式", "联系电话", "手机号", "手机号码", "移动电话", "mobile", "phone", "tel", "电话号码"),
    ID_CARD: ("身份证", "身份证号", "证件号", "身份号码", "ID", "身份证件", "公民身份", "身份证号码", "身份证明", "居民身份证"),
    BANK_CARD: ("银行卡", "卡号", "账号", "银行账号", "信用卡", "借记卡", "储蓄卡", "bank", "card", "account", "银行卡号", "信用卡号"),
    PASSPORT: ("护照", "护照号", "通行证", "passport", "通行证号码", "证件号码", "护照号码", "港澳通行证", "台湾通行证"),
    EMAIL: ("邮箱", "电子邮件", "email", "邮件地址", "联系方式", "电子邮箱", "邮箱地址", "E-mail", "Email", "MAIL"),
    ADDRESS: ("地址", "住址", "居住地", "家庭住址", "通讯地址", "联系地址", "邮寄地址", "收货地址", "发货地址", "办公地址", "公司地址", "户籍地址", "注册地址", "所在地", "address", "addr"),
    NAME: (
        "姓名", "名字", "叫", "是", "联系人", "负责人", "经办人", "收件人", "寄件人", "申请人", "被申请人", "原告", "被告", "证人", "受害人", "嫌疑人", "当事人", "业主", "租户", "房东", "买家", "卖家",
        "客户", "用户", "会员", "员工", "经理", "总监", "董事长", "总经理", "先生", "女士", "小姐", "name",
    ),
}
CONTEXT_WINDOW, CONTEXT_BOOST, CONTEXT_FLOOR = 5, 0.35, 0.4
#: Tokens that are no keywords, stop words and punctuation.
NO_KEYWORDS = ("-", "，", "。", "！", "？")
STOPWORDS = (
    "的", "了", "是", "在", "我", "有", "和", "就", "不", "人", "都", "一", "一个", "上", "也", "很", "到", "说", "要", "去", "你", "会", "着", "没有", "看", "好", "自己", "这", "那", "她", "他", "它",
    "们", "这个", "那个", "什么", "怎么", "吗", "呢", "啊", "吧", "哦", "嗯", "呀", "哈", "嘿", "喂", "哎", "唉",
)
PUNCTUATION = ("，", "。", "！", "？", "；", "：", '"', ",", "'", "（", "）", "【", "】", "《", "》", "、", "…", "—", "～", "·", ".", "!", "?", ";", ":", "(", ")", "[", "]", "<", ">", "-", "_", "/", "\\")
LANGUAGES = ("zh", "chinese", "zh-cn")

#: Keys of extraction results, least length of an address, and beginnings of labels that need no extraction.
NAME_KEYS, ADDRESS_KEYS, MIN_ADDRESS = ("姓名", "人名"), ("地址", "具体地址"), 6
LABELS = (
    "身份证号", "联系方式", "手机号码", "电子邮箱", "家庭住址", "护照号码", "钱包与支付", "储蓄卡", "已通过实名认证", "银行卡", "信用卡", "借记卡", "开户行", "持卡人", "有效期", "安全码", "CVV", "银行", "中国银行",
    "工商银行", "建设银行", "农业银行", "招商银行", "BANK", "OF", "CHINA",
)

#: Thresholds and priorities (a lower number wins) of each type.
DEFAULT_THRESHOLD = 0.35
THRESHOLDS = {NAME: 0.3, ADDRESS: 0.3, PHONE: 0.5, ID_CARD: 0.5, BANK_CARD: 0.5, PASSPORT: 0.5, EMAIL: 0.5}
PRIORITIES = {ID_CARD: 1, BANK_CARD: 2, PHONE: 3, PASSPORT: 4, EMAIL: 5, NAME: 6, ADDRESS: 7}
NO_PRIORITY = 99

#: Requests and images.
MAX_TEXT, MAX_IMAGE_BYTES = 100_000, 10 * 1024 * 1024
IMAGE_FORMATS = ("png", "jpg", "jpeg", "bmp", "gif", "webp")
MOSAIC_STYLES = (("pixel", "one sampled pixel for each block"), ("blur", "running means over the area"), ("fill", "one colour"))
