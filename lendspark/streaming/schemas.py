"""Schema of an application message."""

from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

#: The message's fields.
APPLICATION = StructType(
    [
        StructField("SK_ID_CURR", IntegerType(), True),
        StructField("TARGET", IntegerType(), True),
        StructField("AMT_CREDIT", DoubleType(), True),
        StructField("AMT_INCOME_TOTAL", DoubleType(), True),
        StructField("AMT_ANNUITY", DoubleType(), True),
        StructField("AMT_GOODS_PRICE", DoubleType(), True),
        StructField("NAME_CONTRACT_TYPE", StringType(), True),
        StructField("CODE_GENDER", StringType(), True),
        StructField("DAYS_BIRTH", IntegerType(), True),
        StructField("DAYS_EMPLOYED", IntegerType(), True),
        StructField("EXT_SOURCE_1", DoubleType(), True),
        StructField("EXT_SOURCE_2", DoubleType(), True),
        StructField("EXT_SOURCE_3", DoubleType(), True),
        StructField("FLAG_OWN_CAR", StringType(), True),
        StructField("FLAG_OWN_REALTY", StringType(), True),
        StructField("CNT_FAM_MEMBERS", IntegerType(), True),
        StructField("NAME_INCOME_TYPE", StringType(), True),
        StructField("NAME_EDUCATION_TYPE", StringType(), True),
        StructField("OCCUPATION_TYPE", StringType(), True),
        StructField("timestamp", StringType(), True),
    ]
)
