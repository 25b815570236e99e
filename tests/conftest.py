import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

GO = """package main

import "os"

type Ledger struct {
\tentries []int
\tlimit   int
}

func (l *Ledger) Total() int {
\tsum := 0
\tfor _, e := range l.entries {
\t\tsum += e
\t}
\treturn sum
}

func main() {
\tbook := Ledger{entries: []int{4, 5}, limit: 9}
\tos.Exit(book.Total())
}
"""

JAVA = """class Kettle {
    private double litres;

    double heat(double degrees) {
        litres -= degrees / 1000;
        return litres;
    }
}

public class Kitchen {
    public static void main(String[] args) {
        Kettle k = new Kettle();
        k.heat(80);
    }
}
"""


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def go_tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("golang")
    (root / "main.go").write_text(GO)
    return str(root)


@pytest.fixture(scope="session")
def java_tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("java")
    (root / "Kitchen.java").write_text(JAVA)
    return str(root)
