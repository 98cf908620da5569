"""sessionloom.functions"""
