"""spark-submit entry point for the command line of ``yieldnorm`` (see ``python -m yieldnorm -h``).

    spark-submit --py-files yieldnorm.zip run_analysis.py training --weather W --yields Y --counties C.geojson
"""

from yieldnorm.__main__ import main

if __name__ == "__main__":
    main()
