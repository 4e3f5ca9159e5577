"""spark-submit launcher for the registry report.

    zip -r registry_analytics.zip registry_analytics
    spark-submit --py-files registry_analytics.zip scripts/registry_report.py RELEASE \
        --companies CSV --year 2023 --out OUT_DIR
"""

from registry_analytics.cli import main

if __name__ == "__main__":
    main()
