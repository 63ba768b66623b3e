"""The receipt label schema: fields, aliases, roles and output keys."""

# Fixed values of the label format; results depend on them.
DOCUMENT_FIELDS = ["STORE_NAME", "STORE_ADDRESS", "STORE_PHONE", "STORE_ID", "RECEIPT_ID", "DATE", "TIME", "CASHIER", "REGISTER_ID"]
ITEM_FIELDS = ["ITEM_NAME", "ITEM_CODE", "ITEM_SKU", "ITEM_QTY", "ITEM_UNIT_PRICE", "ITEM_PRICE", "ITEM_DISCOUNT", "ITEM_CATEGORY", "ITEM_OPTION", "ITEM_TAX_FLAG", "ITEM_ETC"]
SUMMARY_FIELDS = ["SUBTOTAL_NAME", "SUBTOTAL_PRICE", "TAX_NAME", "TAX_RATE", "DISCOUNT_NAME", "DISCOUNT_PRICE", "SERVICE_NAME", "SERVICE_PRICE", "TOTAL_NAME", "TOTAL_PRICE", "CASH_NAME", "CASH_PRICE", "CHANGE_NAME", "CHANGE_PRICE", "CARD_NAME", "CARD_PRICE", "TIP_NAME", "TIP_PRICE", "TAX_PRICE"]
PAYMENT_FIELDS = ["PAYMENT_METHOD", "PAYMENT_CARD", "PAYMENT_AUTH_CODE", "PAYMENT_INFO", "APPROVAL_CODE", "TRANSACTION_ID"]
FIELDS = DOCUMENT_FIELDS + ITEM_FIELDS + SUMMARY_FIELDS + PAYMENT_FIELDS

PRICE_FIELDS = ["ITEM_PRICE", "ITEM_UNIT_PRICE", "ITEM_DISCOUNT", "SUBTOTAL_PRICE", "TAX_PRICE", "DISCOUNT_PRICE", "SERVICE_PRICE", "TOTAL_PRICE", "CASH_PRICE", "CHANGE_PRICE", "CARD_PRICE", "TIP_PRICE"]
SUMMARY_HEADS = ["SUBTOTAL_NAME", "TAX_NAME", "TOTAL_NAME", "TIP_NAME"]
HEADS = ["ITEM_NAME", *SUMMARY_HEADS]
ITEM_DEPENDENTS = ["ITEM_PRICE", "ITEM_QTY", "ITEM_UNIT_PRICE", "ITEM_CODE", "ITEM_SKU", "ITEM_DISCOUNT", "ITEM_OPTION", "ITEM_TAX_FLAG", "ITEM_ETC"]
SUMMARY_DEPENDENTS = ["SUBTOTAL_PRICE", "TAX_PRICE", "TAX_RATE", "TOTAL_PRICE", "TIP_PRICE"]
DEPENDENTS = [*ITEM_DEPENDENTS, *SUMMARY_DEPENDENTS]
#: Candidate dependents beside the true ones: all summary and payment fields and these of the document.
HARD_NEGATIVES = ["STORE_NAME", "STORE_ADDRESS", "STORE_PHONE", "DATE", "TIME", "RECEIPT_ID", *SUMMARY_FIELDS, *PAYMENT_FIELDS]

#: Older field names to fields.
ALIASES = {
    "MENU_NM": "ITEM_NAME", "MENU_SUB_NM": "ITEM_OPTION", "MENU_CNT": "ITEM_QTY", "MENU_NUM": "ITEM_CODE", "MENU_UNITPRICE": "ITEM_UNIT_PRICE", "MENU_PRICE": "ITEM_PRICE",
    "MENU_DISCOUNTPRICE": "ITEM_DISCOUNT", "MENU_ITEMSUBTOTAL": "ITEM_PRICE", "MENU_VATYN": "ITEM_TAX_FLAG", "MENU_ETC": "ITEM_ETC", "MENU_SUB_PRICE": "ITEM_PRICE",
    "MENU_SUB_CNT": "ITEM_QTY", "MENU_SUB_UNITPRICE": "ITEM_UNIT_PRICE", "MENU_SUB_ETC": "ITEM_ETC", "VOID_MENU_NM": "ITEM_NAME", "VOID_MENU_PRICE": "ITEM_PRICE",
    "TOTAL_TOTAL_PRICE": "TOTAL_PRICE", "TOTAL_CASHPRICE": "CASH_PRICE", "TOTAL_CHANGEPRICE": "CHANGE_PRICE", "TOTAL_CREDITCARDPRICE": "CARD_PRICE",
    "TOTAL_EMONEYPRICE": "CARD_PRICE", "TOTAL_TOTAL_ETC": "PAYMENT_INFO", "TOTAL_MENUTYPE_CNT": "PAYMENT_INFO", "TOTAL_MENUQTY_CNT": "PAYMENT_INFO",
    "SUBTOTAL_SUBTOTAL_PRICE": "SUBTOTAL_PRICE", "SUBTOTAL_TAX_PRICE": "TAX_PRICE", "SUBTOTAL_DISCOUNT_PRICE": "DISCOUNT_PRICE", "SUBTOTAL_SERVICE_PRICE": "SERVICE_PRICE", "SUBTOTAL_OTHERSVC_PRICE": "SERVICE_PRICE", "SUBTOTAL_ETC": "PAYMENT_INFO",
    "SUB_TOTAL_SUBTOTAL_PRICE": "SUBTOTAL_PRICE", "SUB_TOTAL_TAX_PRICE": "TAX_PRICE", "SUB_TOTAL_DISCOUNT_PRICE": "DISCOUNT_PRICE", "SUB_TOTAL_SERVICE_PRICE": "SERVICE_PRICE", "SUB_TOTAL_OTHERSVC_PRICE": "SERVICE_PRICE", "SUB_TOTAL_ETC": "PAYMENT_INFO",
}

#: Fields to the older name that stands for them.
OLD_NAMES = {
    "ITEM_NAME": "MENU_NM", "ITEM_OPTION": "MENU_SUB_NM", "ITEM_QTY": "MENU_CNT", "ITEM_UNIT_PRICE": "MENU_UNITPRICE", "ITEM_PRICE": "MENU_PRICE", "ITEM_DISCOUNT": "MENU_DISCOUNTPRICE",
    "ITEM_ETC": "MENU_ETC", "TOTAL_PRICE": "TOTAL_TOTAL_PRICE", "CASH_PRICE": "TOTAL_CASHPRICE", "CHANGE_PRICE": "TOTAL_CHANGEPRICE", "CARD_PRICE": "TOTAL_CREDITCARDPRICE",
    "SUBTOTAL_PRICE": "SUBTOTAL_SUBTOTAL_PRICE", "TAX_PRICE": "SUBTOTAL_TAX_PRICE", "DISCOUNT_PRICE": "SUBTOTAL_DISCOUNT_PRICE", "SERVICE_PRICE": "SUBTOTAL_SERVICE_PRICE", "PAYMENT_INFO": "SUBTOTAL_ETC",
}

#: Output keys that are not the field in lower case.
OUTPUT_KEYS = {"ITEM_QTY": "quantity", "ITEM_UNIT_PRICE": "unit_price", "ITEM_PRICE": "price", "ITEM_DISCOUNT": "discount", "ITEM_OPTION": "options", "ITEM_TAX_FLAG": "tax_flag"}
#: Slots of an item that hold a list.
LIST_SLOTS = ["options", "item_etc"]
#: Section and slot of a summary edge, by its head and dependent.
SUMMARY_SLOTS = {
    ("SUBTOTAL_NAME", "SUBTOTAL_PRICE"): ("subtotal", "subtotal_price"),
    ("TAX_NAME", "TAX_PRICE"): ("subtotal", "tax_price"),
    ("TAX_NAME", "TAX_RATE"): ("subtotal", "tax_rate"),
    ("TOTAL_NAME", "TOTAL_PRICE"): ("total", "total_price"),
    ("TIP_NAME", "TIP_PRICE"): ("total", "tip_price"),
}
THRESHOLD = 0.84
LOW_MARGIN = 0.05
