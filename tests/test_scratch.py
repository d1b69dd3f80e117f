from tidevec import scratch


def heap(spark):
    java = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    return java.totalMemory() - java.freeMemory()


def test_a_full_heap_is_collected_after_a_table(spark, monkeypatch):
    seen, plain = [], scratch.collect

    def collect(session):
        seen.append(heap(session))
        plain(session, 1 << 20)  # whatever is in use is too much
        seen.append(heap(session))

    monkeypatch.setattr(scratch, "collect", collect)
    spark.sparkContext._jvm.java.lang.StringBuilder(1 << 26)
    assert scratch.materialise(spark.range(3), "few").count() == 3
    assert seen[1] < seen[0] - 50e6


def test_freed_memory_is_given_back():
    def held():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    kept = [bytes(100_000) for _ in range(2000)]
    last, before = kept[-1], held()
    del kept
    scratch.give_back()
    assert held() < before - 50e6 and last is not None
